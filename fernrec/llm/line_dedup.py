"""Operator 8: repeated lines by a deletion-neighbourhood join.

A line's words are its runs without ASCII white space, A-Z lower-cased. Lines
of at least ``min_words`` words (by default: any line with a word) that equal
an earlier line are dropped, and so are lines of at least ``near_words`` words
within one word edit (a word replaced, added or left out) of an earlier such
line; below five words one edit changes too much of a line to call it a
repeat. Earlier means by id (ascending, null last), then text digest, then
place in the text. The rule asks for an earlier line, kept or not, so the
result does not depend on the order of work.

1. One scan hashes every line, and its first and last m words. One edit leaves
   one of these two runs alone (m is under half the words, by powers of two),
   so only lines that share such a run with another line need variants.
2. Those lines emit, hashed, the line and every variant with one word left
   out. Lines with equal variants at the same place differ by one replaced
   word; a variant equal to a whole line is one added word. Minima per key
   find the earliest line; no pairs of a group are formed.
3. Found pairs (line, earliest) are verified word by word.

Edge cases: a null text has no lines and stays null; an empty text has one
empty line; lines without words are never dropped; rows equal in id and text
are one document and get equal results; extra columns are kept by
``drop_repeated_lines``; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prepare import rank_rows
from .common import ascii_lower, lean, whole_text, written
from .near_dedup import mix64

MIN_WORDS = 1
NEAR_WORDS = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _words(line: Column) -> Column:
    return F.filter(F.split(ascii_lower(line), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))


def _placed(words: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of words at places; sums of them stand for word sequences."""
    return mix64(words + mix64((places + salt).astype(np.uint64) * _GOLD))


def _sums(parts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])


def run_length(n: np.ndarray) -> np.ndarray:
    """m of a line of n >= 4 words: a power of two, at most (n - 1) / 2."""
    return 1 << np.maximum(np.log2(np.maximum(n - 1, 2)).astype(np.int64) - 1, 0)


def _hash_lines(min_words: int, near_words: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = batch.column("lines")
            inner = outer.values
            docs = outer.offsets.to_numpy().astype(np.int64)
            ends = inner.offsets.to_numpy().astype(np.int64)
            words = inner.values.to_numpy(zero_copy_only=False).view(np.uint64)
            lines = np.arange(docs[0], docs[-1])
            starts, stops = ends[lines], ends[lines + 1]
            n = stops - starts
            doc = np.repeat(np.arange(batch.num_rows), np.diff(docs))
            line_no = lines - docs[doc]
            at = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
            back = np.repeat(np.diff(ends), np.diff(ends)) - at
            front = _sums(_placed(words, at, 1))
            rear = _sums(_placed(words, back, 1 << 40))
            h1 = mix64(front[stops] - front[starts] + n.astype(np.uint64))
            h2 = mix64(rear[stops] - rear[starts] + n.astype(np.uint64))
            keep = n >= min_words
            near = n >= near_words
            m, less = run_length(n), run_length(n - 1)
            keys = np.zeros((4, len(n)), np.int32)
            for k, size in ((0, m), (2, less)):
                size = np.where(near, size, 0)
                salt = size.astype(np.uint64) * _GOLD
                keys[k] = mix64(front[starts + size] - front[starts] + salt).astype(np.uint32).view(
                    np.int32)
                keys[k + 1] = (mix64(rear[stops] - rear[stops - size] + salt * np.uint64(3))
                               .astype(np.uint32).view(np.int32))
            # the runs of one word less differ only where the power changes,
            # and only a line that may be the longer of a pair needs them
            both = near & (m != less) & (n > near_words)
            count = np.where(near, np.where(both, 4, 2), 0)[keep]
            grid = np.arange(4)[None, :] < count[:, None]
            ids = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(ids), batch.column("t").take(ids),
                 pa.array(line_no[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)),
                 pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)),
                 pa.ListArray.from_arrays(
                     pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()),
                     pa.array(keys.T[keep][grid]))],
                names=["doc_id", "t", "line_no", "n", "h1", "h2", "runs"])
    return hashed


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, line): the line itself (place -1) and its deletions."""
    for batch in batches:
        lists = batch.column("words")
        ends = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].view(np.uint64)
        ends = ends - ends[0]
        n = np.diff(ends)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(words)) - ends[:-1][owner]
        here, left = _sums(_placed(words, at, 1)), _sums(_placed(words, at - 1, 1))
        whole = mix64(here[ends[1:]] - here[ends[:-1]] + n.astype(np.uint64) * _GOLD)
        places = np.arange(len(words))
        less = mix64(here[places] - here[ends[:-1][owner]] + left[ends[1:][owner]]
                     - left[places + 1] + (n[owner] - 1).astype(np.uint64) * _GOLD)
        line = batch.column("line").to_numpy()
        for lo in range(0, len(words), 1 << 18):
            hi = lo + (1 << 18)
            yield _variant_rows(less[lo:hi], at[lo:hi], line[owner[lo:hi]])
        yield _variant_rows(whole, np.full(len(n), -1), line)


def _variant_rows(keys, places, lines) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(places.astype(np.int32)),
         pa.array(lines.astype(np.int64))], names=["key", "place", "line"])


def within_one_edit(a: list, b: list) -> bool:
    """At most one element replaced, added or left out."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1:] == b[k + 1:]
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[k + 1:] == shorter[k:]


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ok = [within_one_edit(a.split(" "), b.split(" "))
              for a, b in zip(frame["words_a"], frame["words_b"])]
        yield frame.loc[np.array(ok, bool), ["line"]]


def _near_repeats(lines: DataFrame, docs: DataFrame, near_words: int) -> DataFrame:
    """doc_id, t, line_no of first occurrences within one edit of an earlier
    line."""
    runs = lines.filter(F.col("n") >= near_words).select("h1", "h2", F.explode("runs").alias("run"))
    shared = (runs.groupBy("run").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
              .filter(F.col("lo") < F.col("hi")).select("run"))
    wanted = runs.join(shared, "run", "left_semi").select("h1", "h2").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "line_no"))
    firsts = (lines.join(wanted, ["h1", "h2"], "left_semi").groupBy("h1", "h2")
              .agg(first.alias("at")).select("at.no_id", "at.doc_id", "at.t", "at.line_no"))
    # the lines' words: the documents that have such lines, then the lines
    firsts = written(firsts, "line_firsts")
    row = ["doc_id", "t"]
    place = lambda x, y, names: functools.reduce(
        lambda c, n: c & x[n].eqNullSafe(y[n]), names, F.lit(True))
    owners = firsts.select(*row).distinct()
    split = (docs.join(owners, place(docs, owners, row), "left_semi")
             .select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "text")))
    found = (split.join(firsts, place(split, firsts, [*row, "line_no"]), "left_semi")
             .select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "line_no",
                     F.concat_ws(" ", _words(F.col("text"))).alias("words"))
             .dropDuplicates(["doc_id", "t", "line_no"]))
    ranked = rank_rows(found, ["no_id", "doc_id", "t", "line_no"], "line")
    hashes = F.transform(F.split("words", " "), lambda w: F.xxhash64(w))
    variants = written(ranked.select("line", hashes.alias("words")).mapInArrow(
        lean(_variants), "key bigint, place int, line bigint"), "variants")
    by_place = variants.groupBy("key", "place").agg(
        F.min("line").alias("first"), F.max("line").alias("last"))
    by_place = written(by_place, "variant_minima")
    # one word replaced: an earlier line with the same variant at that place
    replaced = (variants.join(by_place.filter((F.col("place") >= 0)
                                              & (F.col("first") < F.col("last"))),
                              ["key", "place"])
                .filter(F.col("line") > F.col("first")).select("line", "first"))
    # one word added or left out: a variant that is a whole line
    whole = by_place.filter("place < 0").select("key", F.col("first").alias("whole"))
    cut = (by_place.filter("place >= 0").groupBy("key").agg(F.min("first").alias("cut"))
           .join(whole, "key"))
    cut = written(cut, "variant_wholes")
    shorter = cut.filter(F.col("cut") < F.col("whole")).select(
        F.col("whole").alias("line"), F.col("cut").alias("first"))
    longer = (variants.filter("place >= 0").join(cut.select("key", "whole"), "key")
              .filter(F.col("line") > F.col("whole"))
              .select("line", F.col("whole").alias("first")))
    pairs = replaced.unionByName(shorter).unionByName(longer).distinct()
    words = ranked.select("line", "words")
    checked = (pairs.join(words.withColumnRenamed("words", "words_a"), "line")
               .join(words.select(F.col("line").alias("first"), F.col("words").alias("words_b")),
                     "first")
               .select("line", "words_a", "words_b")
               .mapInPandas(_verify, "line bigint").distinct())
    return ranked.join(checked, "line", "left_semi").select("doc_id", "t", "line_no")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, t (64-bit text digest), line_no (from 0), near (within one edit,
    not equal) of every line to drop."""
    if not 0 < min_words <= near_words or near_words < 4:
        raise ValueError("0 < min_words <= near_words and near_words >= 4")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"),
                       whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hashed = F.transform(F.split("text", "\n"),
                         lambda line: F.transform(_words(line), lambda w: F.xxhash64(w)))
    lines = written(rows.select("doc_id", "t", hashed.alias("lines")).mapInArrow(
        lean(_hash_lines(min_words, near_words)), f"doc_id {kind}, t bigint, line_no int, n int, "
        "h1 bigint, h2 bigint, runs array<int>"), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "line_no")
    firsts = (lines.groupBy("h1", "h2").agg(F.min(order).alias("f"), F.max(order).alias("l"))
              .filter(F.col("f") != F.col("l")).select("h1", "h2", "f"))
    again = (lines.join(firsts, ["h1", "h2"]).filter(order != F.col("f"))
             .select("doc_id", "t", "line_no"))
    near = _near_repeats(lines, rows, near_words)
    return again.distinct().withColumn("near", F.lit(False)).unionByName(
        near.distinct().withColumn("near", F.lit(True)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """doc_id, n_lines, n_repeated (equal lines dropped), n_near (others
    dropped) of every row."""
    gone = (repeated_lines(docs, id_col, text_col, **options)
            .groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
            .agg(F.sum((~F.col("near")).cast("bigint")).alias("n_repeated"),
                 F.sum(F.col("near").cast("bigint")).alias("n_near")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_row"),
                       F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("bigint"))
    return (rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["_row"] == gone["_t"]),
                      "left")
            .select("doc_id", "n_lines", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
                    F.coalesce("n_near", F.lit(0)).alias("n_near")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        drop_emptied: bool = True, **options) -> DataFrame:
    """``docs`` with the repeated lines cut out of their texts, all columns
    kept; documents left without any word go if ``drop_emptied``."""
    gone = (repeated_lines(docs, id_col, text_col, **options)
            .groupBy(F.col("doc_id").alias("_gone_id"), F.col("t").alias("_gone_t"))
            .agg(F.collect_set("line_no").alias("_gone_nos")))
    # the runs of lines between dropped places
    nos = F.array_sort(F.coalesce("_gone_nos", F.array().cast("array<int>")))
    lines = F.split(F.col(text_col), "\n")
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), nos), F.concat(nos, F.array(F.size(lines))),
                      lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n")))
    cut = F.flatten(F.transform("_gone_runs", lambda r: F.slice("_gone_lines", r["at"], r["n"])))
    text = F.when(F.size(nos) == 0, F.col(text_col)).otherwise(F.array_join(cut, "\n"))
    out = (docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"])
                     & (F.xxhash64(docs[text_col]) == gone["_gone_t"]), "left")
           .withColumns({"_gone_runs": runs, "_gone_lines": lines})
           .withColumn("_gone_text", text))
    if drop_emptied:
        out = out.filter((F.size(nos) == 0) | F.col("_gone_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("_gone_text").alias(c) if c == text_col else docs[c]
                        for c in docs.columns])
