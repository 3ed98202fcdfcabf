"""Operator 1: token counts by overlap resynchronisation.

Texts up to ``chunk_chars`` characters are counted where they are scanned.
A longer text is cut into overlapping chunks that Spark deals to all tasks;
each chunk is encoded on its own, with offsets. Neighbours are spliced at a
boundary inside their overlap that is proven stable: it follows ASCII white
space and starts with an ASCII letter or digit (no token, special string or
canonical composition crosses such a place), both encodings start a token
there, and both give the same tokens from there to the next such place. A
pair without one fails; its text goes through another round with chunks and
overlap four times as wide, until one chunk holds the whole text.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); a null id is
kept; repeated rows give one result row each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, whole_text, written
from .tokens import WORD_BPE, encoder, text_slices, vocabulary_path

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 11
WIDEN = 4


def stable_starts(text: str, lo: int, hi: int) -> np.ndarray:
    """Places p of [lo, hi) where an ASCII letter or digit follows ASCII white
    space: a token starts there in whichever chunk holds p - 1 and p."""
    part = np.frombuffer(text[max(lo - 1, 0):hi].encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (part == 32) | ((part >= 9) & (part <= 13))
    word = (((part >= 48) & (part <= 57)) | ((part >= 65) & (part <= 90))
            | ((part >= 97) & (part <= 122)))
    return np.nonzero(space[:-1] & word[1:])[0] + max(lo - 1, 0) + 1


def zone_digest(text: str, base: int, starts: np.ndarray, ids: np.ndarray,
                lo: int, hi: int) -> list[tuple[int, int, str]]:
    """The stable places p of the zone [lo, hi) that start a token: (p as a
    place of the whole text, tokens of the chunk before p, the tokens from p to
    the next stable place). The last place has no successor and is left out."""
    places = stable_starts(text, lo, hi)
    at = np.searchsorted(starts, places)
    ok = at < len(starts)
    ok[ok] &= starts[at[ok]] == places[ok]
    places, at = places[ok], at[ok]
    return [(int(base + p), int(a), ",".join(map(str, ids[a:b].tolist())))
            for p, a, b in zip(places, at, at[1:])]


def splice(chunks: list[dict]) -> int | None:
    """Tokens of the whole text from its chunks in order; None if a pair of
    neighbours agrees at no stable place."""
    total = since = 0
    for left, right in zip(chunks, chunks[1:]):
        known = {(p, run): n for p, n, run in left["tail"]}
        cut = next(((known[p, run], n) for p, n, run in right["head"] if (p, run) in known), None)
        if cut is None:
            return None
        total += cut[0] - since
        since = cut[1]
    return total + chunks[-1]["n"] - since


_ZONE = "array<struct<p:bigint,n:bigint,run:string>>"


def _chunk_rows(step: int, overlap: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["_k"], frame["text"]):
                rows = []
                for k, lo in enumerate(range(0, max(len(text) - overlap, 1), step)):
                    rows.append((key, k, lo, lo + step + overlap >= len(text),
                                 text[lo:lo + step + overlap]))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=["_k", "k", "lo", "last", "chunk"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["_k", "k", "lo", "last", "chunk"])
    return cut


def _encode_chunks(path: str, overlap: int):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = encoder(path).tokenizer
        for frame in frames:
            out = []
            for key, k, lo, last, text in frame.itertuples(index=False):
                found = tokenizer.encode(text, add_special_tokens=False)
                ids = np.array(found.ids, np.int64)
                starts = np.array([a for a, _ in found.offsets], np.int64)
                head = zone_digest(text, lo, starts, ids, 0, overlap) if k else []
                tail = ([] if last else
                        zone_digest(text, lo, starts, ids, len(text) - overlap, len(text)))
                out.append((key, k, len(ids), head, tail))
            yield pd.DataFrame(out, columns=["_k", "k", "n", "head", "tail"])
    return encode


def _splice_group(frame: pd.DataFrame) -> pd.DataFrame:
    def zone(cells) -> list:
        return [(c["p"], c["n"], c["run"]) for c in cells]

    frame = frame.sort_values("k")
    chunks = [{"n": int(n), "head": zone(h), "tail": zone(t)}
              for n, h, t in zip(frame["n"], frame["head"], frame["tail"])]
    return pd.DataFrame({"_k": [frame["_k"].iloc[0]], "n_tokens": [splice(chunks)]}).astype(
        {"n_tokens": "Int64"})


def _long_counts(texts: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(_k, n_tokens) of long texts (_k, text), _k unique."""
    done = None
    while True:
        chunks = texts.mapInPandas(
            _chunk_rows(chunk_chars - overlap, overlap),
            "_k string, k bigint, lo bigint, last boolean, chunk string")
        counted = written(
            chunks.repartition("_k", "k")
            .mapInPandas(_encode_chunks(path, overlap),
                         f"_k string, k bigint, n bigint, head {_ZONE}, tail {_ZONE}")
            .groupBy("_k").applyInPandas(_splice_group, "_k string, n_tokens bigint"),
            "token_counts")
        good = counted.filter(F.col("n_tokens").isNotNull())
        done = good if done is None else done.unionByName(good)
        failed = counted.filter(F.col("n_tokens").isNull()).select("_k")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "_k", "left_semi")
        chunk_chars, overlap = chunk_chars * WIDEN, overlap * WIDEN


def _count_short(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"),
                     pa.array(enc.counts(texts), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return count


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, limit: int = 2048,
                 chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""
    path = tokenizer or vocabulary_path(WORD_BPE)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.length("text") > F.lit(chunk_chars)
    short = (rows.filter(~is_long)
             .select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
             .mapInArrow(_count_short(path),
                         f"doc_id {kind}, n_bytes bigint, n_tokens bigint"))
    # repeated rows of a long text are counted once and given back as often
    long = (rows.filter(is_long).withColumn("_k", row_key("doc_id", "text"))
            .groupBy("_k").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"),
                               F.count(F.lit(1)).alias("_copies")))
    long = written(long, "long_texts")
    counted = _long_counts(long.select("_k", "text"), path, chunk_chars, overlap_chars)
    spliced = (long.select("_k", "doc_id", "_copies",
                           F.octet_length("text").cast("bigint").alias("n_bytes"))
               .join(counted, "_k")
               .select("doc_id", "n_bytes", "n_tokens",
                       F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
               .drop("_copy"))
    return (short.unionByName(spliced)
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
