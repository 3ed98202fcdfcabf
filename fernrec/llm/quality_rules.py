"""Operator 7: quality rules by tokeniser fertility.

Every whole text is encoded word by word with a public vocabulary. Four
figures describe how well the vocabulary fits it: characters per token, tokens
per word, the share of byte-fallback tokens, and the entropy of its tokens (bits, as a share
of the bits of its length). Rejection bands are learned per language (or, for
rows without one, per script) from all distinct texts (by md5; exact copies
count once, near copies each) that pass the base rules: a straight line in the
logarithm of the number of tokens takes out the effect of length; then, per
length class, the median of what remains plus or minus ``width`` times the
distance to the quartile of that side, at least ``least``. A class with fewer
than ``least_docs`` distinct texts takes the band of its language, failing
that the band of all, or none.

Base rules: at least ``min_words`` words, and at most half of the words in
3-word windows that occur twice or more in the text.

Edge cases: a null or empty text has no words and fails the base rules;
repeated rows give one result row each; a null language falls back to the
script; null ids are kept; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written, written_counted
from .tokens import PIECE_BPE, encoder, text_slices, vocabulary_path

# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BROADCAST_GROUPS = 100_000
METRICS = ("chars_per_token", "tokens_per_word", "byte_share", "token_entropy")
_SYMBOL_TABLE = bytes(sorted(set(range(256)) - set(SYMBOLS.encode())))
# Blocks of code points of common scripts.
_SCRIPTS = [("latin", r"[A-Za-zÀ-ɏ]"), ("cyrillic", r"[Ѐ-ԯ]"),
            ("greek", r"[Ͱ-Ͽ]"), ("arabic", r"[؀-ۿ]"),
            ("devanagari", r"[ऀ-ॿ]"), ("kana", r"[぀-ヿ]"),
            ("han", r"[一-鿿]"), ("hangul", r"[가-힯]")]
_SCRIPT_RE = [(name, re.compile(pattern)) for name, pattern in _SCRIPTS]


def script_of(text: str) -> str:
    """The script with the most letters; ``other`` without any known one."""
    count, name = max((sum(1 for _ in p.finditer(text)), name) for name, p in _SCRIPT_RE)
    return name if count else "other"


def repeat_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    ids = ids.astype(np.int64)
    if ids.max() >= 1 << 21:
        ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.nonzero(counts[back] > 1)[0]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def token_entropy(ids: np.ndarray) -> float:
    """Bits per token over the bits of the length (1 for up to one token)."""
    if len(ids) < 2:
        return 1.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum() / np.log2(len(ids)))


def _figures(text: bytes, lang: str | None, words: np.ndarray, ids: np.ndarray,
             is_byte: np.ndarray | None) -> tuple:
    """The figures of one text: ``words`` are numbers of its words, ``ids`` its tokens."""
    chars = len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    # code points in words: all but ASCII white space
    chars -= len(text) - len(text.translate(None, b" \t\n\v\f\r"))
    n = len(ids)
    return (len(words), chars, len(text.translate(None, _SYMBOL_TABLE)),
            repeated_lines(text), repeat_words(words), n, chars / n if n else 0.0,
            n / len(words) if len(words) else 0.0,
            float(is_byte[ids].mean()) if n and is_byte is not None else 0.0,
            token_entropy(ids), lang if lang is not None else
            "script:" + script_of(text.decode("utf-8", "replace")))


def _measure(path: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        is_byte = getattr(enc, "is_byte", None)
        for batch in batches:
            rows = []
            langs = batch.column("lang").to_pylist()
            for lo, texts in text_slices(batch.column("text")):
                for first, sizes, places in enc.pieces(texts):
                    ids, ends = enc.ids_of(places)
                    stops = np.cumsum(sizes).tolist()
                    for k, (size, stop) in enumerate(zip(sizes.tolist(), stops), first):
                        rows.append(_figures(texts[k], langs[lo + k], places[stop - size:stop],
                                             ids[ends[stop - size]:ends[stop]], is_byte))
            columns = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"),
                 *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "n_tokens", *METRICS, "group"])
    return measure


def _bands(rest: DataFrame, keys: list[str], width: float, least: dict[str, float],
           least_docs: int, tag: str) -> DataFrame:
    """lo/hi of every metric's remainder per ``keys``, for groups of enough
    rows of ``rest``, one per distinct text."""
    parts = [F.percentile_approx(f"rest_{m}", [0.25, 0.5, 0.75], 10_000).alias(m) for m in METRICS]
    found = (rest.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n"), *parts).filter(F.col("n") >= least_docs))
    out = [*keys]
    for m in METRICS:
        q = F.col(m)
        for name, side, sign in (("lo", 0, -1), ("hi", 2, 1)):
            gap = F.greatest(F.lit(width) * F.abs(q[side] - q[1]), F.lit(least[m]))
            out.append((q[1] + sign * gap).alias(f"{tag}_{name}_{m}"))
    return found.select(*out)


def _small(table: DataFrame, name: str) -> DataFrame:
    """Written, and marked for broadcast if its counted rows allow that: a
    language of a third of all rows is then not sent to one task. With more
    groups than that none is so large, or AQE splits it."""
    table, rows = written_counted(table, name)
    return F.broadcast(table) if rows <= BROADCAST_GROUPS else table


def _lines(texts: DataFrame) -> DataFrame:
    """Per group, the line of every metric in log2(n_tokens), and its mean."""
    at = F.log2(F.greatest("n_tokens", F.lit(1)))
    return texts.groupBy("group").agg(*[e for m in METRICS for e in (
        F.regr_slope(F.col(m), at).alias(f"slope_{m}"),
        F.regr_intercept(F.col(m), at).alias(f"base_{m}"), F.avg(m).alias(f"mean_{m}"))])


def _without_length(measured: DataFrame, lines: DataFrame) -> DataFrame:
    """With rest_<metric>: what the group's line in log2(n_tokens) leaves."""
    at = F.log2(F.greatest("n_tokens", F.lit(1)))
    rest = measured.join(lines, "group", "left")
    return rest.select(*measured.columns, *[
        (F.col(m) - F.coalesce(F.col(f"base_{m}") + F.col(f"slope_{m}") * at, f"mean_{m}",
                               F.lit(0.0))).alias(f"rest_{m}") for m in METRICS])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", vocabulary: str | None = None, min_words: int = 50,
                  width: float = 7.0, least: dict[str, float] | None = None,
                  least_docs: int = 30) -> DataFrame:
    """doc_id, the base figures, the fertility figures, base_failed, kept and
    reasons (names of the figures out of their band) of every row."""
    least = least or {"chars_per_token": 0.05, "tokens_per_word": 0.1, "byte_share": 0.05,
                      "token_entropy": 0.01}
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"),
                       F.unhex(F.md5(whole_text(text_col))).alias("copy"),
                       F.col(lang_col).cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = "n_words n_symbols word_chars n_dup_lines n_repeat_words n_tokens".split()
    measured = written(
        rows.mapInArrow(
            _measure(vocabulary or vocabulary_path(PIECE_BPE)),
            f"doc_id {kind}, copy binary, n_words bigint, word_chars bigint, n_symbols bigint, "
            "n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, "
            "chars_per_token double, tokens_per_word double, byte_share double, "
            "token_entropy double, group string")
        .withColumn("base_failed", (F.col("n_words") < min_words)
                    | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")),
        "quality")
    # one row per text and group: copies have the same figures
    texts = written(measured.filter(~F.col("base_failed")).dropDuplicates(["group", "copy"])
                    .select("group", "size", "n_tokens", *METRICS), "quality_texts")
    lines = _small(_lines(texts), "quality_lines")
    learned = written(_without_length(texts, lines), "quality_learned")
    rest = _without_length(measured, lines)
    levels = [("class", ["group", "size"]), ("group", ["group"]), ("all", [])]
    rated = rest
    for tag, keys in levels:
        bands = _small(_bands(learned, keys, width, least, least_docs, tag), "quality_bands")
        rated = rated.join(bands, keys, "left") if keys else rated.join(
            bands, F.lit(True), "left")  # one row
    reasons = []
    for m in METRICS:
        lo, hi = (F.coalesce(*[f"{tag}_{side}_{m}" for tag, _ in levels]) for side in ("lo", "hi"))
        value = F.col(f"rest_{m}")
        out = (value > hi) if m == "byte_share" else (value < lo) | (value > hi)
        reasons.append(F.when(out, F.lit(m)))
    rated = rated.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return rated.select("doc_id", *sorted(names), *METRICS, "base_failed",
                        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"),
                        "reasons")
