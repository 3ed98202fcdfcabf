"""Operator 6: toxic passages as maximum-scoring segments of token log-odds.

Training counts, for both labels, in how many documents each word occurs. The
words are hashed to ``2^bits`` buckets, which bounds the model whatever the
vocabulary; every distinct text of a label counts, exact copies (by md5) once
and near copies each. A bucket's score is the log-odds ratio of the labels
under an informative Dirichlet prior (the background frequency, as ``prior``
of all counts); buckets whose ratio is below ``min_odds`` or whose
likelihood-ratio root is below ``z_min``, and all unseen ones, cost ``drift``.

A document is scanned once (Ruzzo and Tompa's linear scan) for all its
maximal segments. Under the score distribution of documents with label 0 the
best of n tokens exceeds x with probability 1 - exp(-K n exp(-lambda x))
(Karlin and Altschul); segments with an expected number of such under
``max_e`` are significant passages. A document's evidence is -log10 of the
chance of its best segment plus that of every further significant one, and a
logistic curve, fitted on at most ``fit_rows`` labelled training rows, turns
it into a score.

Edge cases: a null or empty text has no passages and gets the score of no
evidence; null labels are ignored; of repeated labels of an id the largest
counts; repeated rows give one result row each; rows with a null id are
scored and never trained on; without labels of both kinds every score is the
share of label 1 (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean, row_key, whole_text, written
from .decontamination import words_of

BITS = 22
BROADCAST_ROWS = 2_000_000


@dataclass
class ToxicModel:
    """Scores of the significant buckets (sorted), and the calibration."""

    bits: int
    buckets: np.ndarray
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    max_e: float
    weights: tuple[float, float] = (0.0, 0.0)  # logistic: intercept, evidence

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * evidence, -50, 50)))


def maximal_segments(places: np.ndarray, scores: np.ndarray,
                     drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last place, score) of a sequence
    whose scored tokens stand at ``places`` and whose others cost ``drift``
    each; in order. One pass (Ruzzo and Tompa 1999)."""
    found: list[list[float]] = []  # first, last, total before, total after
    total, end = 0.0, 0
    for p, s in zip(places.tolist(), scores.tolist()):
        total -= drift * (p - end)
        end = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [p, p, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], p, found[j][2], total]
            del found[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in found]


def karlin_lambda(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive solution of sum(shares * exp(lambda * scores)) = 1."""
    lo, hi = 1e-6, 1.0
    value = lambda lam: float(np.sum(shares * np.exp(lam * scores)))
    while value(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def _with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, ...) that have a label; the label table is broadcast
    only below a checked number of rows."""
    if labels.count() <= BROADCAST_ROWS:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id")


def _buckets(text_col: str, bits: int):
    return F.transform(words_of(whole_text(text_col)),
                       lambda w: F.pmod(F.xxhash64(w), F.lit(1 << bits)).cast("int"))


def _word_counts(rows: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    """bucket, t, c: the distinct texts with label 1 and 0 that have a word of
    the bucket."""
    texts = (_with_labels(rows, known)
             .select("toxic", F.md5(whole_text("text")).alias("copy"),
                     F.array_distinct(_buckets("text", bits)).alias("b"))
             .dropDuplicates(["toxic", "copy"]))
    return (texts.select("toxic", F.explode("b").alias("bucket")).groupBy("bucket")
            .agg(F.sum("toxic").cast("double").alias("t"),
                 F.sum(1 - F.col("toxic")).cast("double").alias("c")))


def _scan(shared):
    """Segments of every document: best, evidence, number and passages."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicModel = shared.value
        table = np.full(1 << model.bits, np.nan, np.float32)
        table[model.buckets] = model.scores
        passages = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()),
                                       ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            lists = batch.column("buckets")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            scores = table[values[offsets[0]:offsets[-1]]] if len(values) else np.zeros(0)
            base = offsets[0]
            offsets = offsets - base
            known = np.nonzero(~np.isnan(scores))[0]
            ends = np.searchsorted(known, offsets)
            n = len(offsets) - 1
            best, evidence = np.zeros(n), np.zeros(n)
            found: list = [[] for _ in range(n)]
            above = np.zeros(n, np.int64)
            for d in np.nonzero(np.diff(ends))[0].tolist():
                at = known[ends[d]:ends[d + 1]]
                segments = maximal_segments(at - offsets[d], scores[at].astype(float), model.drift)
                if not segments:
                    continue
                words = int(offsets[d + 1] - offsets[d])
                above[d] = len(segments)
                best[d] = max(s[2] for s in segments)
                rated = [(a, b, s, model.k * words * math.exp(-model.lam * s))
                         for a, b, s in segments]
                found[d] = [dict(first_word=a, last_word=b, score=s, e_value=e)
                            for a, b, s, e in rated if e <= model.max_e]
                chances = sorted(-math.expm1(-e) for *_, e in rated)
                evidence[d] = sum(min(-math.log10(max(c, 1e-30)), 30.0) for k, c in
                                  enumerate(chances) if k == 0 or c <= model.max_e)
            names = ["_k", "doc_id", "in_train", "toxic", "n_words", "n_segments", "best", "evidence",
                     "passages"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), batch.column("doc_id"), batch.column("in_train"),
                 batch.column("toxic"),
                 pa.array(np.diff(offsets)), pa.array(above), pa.array(best), pa.array(evidence),
                 pa.array(found, passages)], names=names)
    return scan


def _log_odds(counts: DataFrame, totals: dict[int, float], prior: float, z_min: float,
              min_odds: float) -> DataFrame:
    """bucket, score, c: buckets whose log-odds ratio is significant."""
    t_all, c_all = F.lit(totals[1]), F.lit(totals[0])
    t, c = F.col("t"), F.col("c")
    a = F.lit(prior) * (t + c)  # pseudo-counts: the background frequency
    odds = lambda x, total: F.log((x + a) / (total * (1 + prior) - x - a))
    expected = (t + c) * t_all / (t_all + c_all)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(t, expected) + part(c, t + c - expected))
    return (counts.select("bucket", "c", (odds(t, t_all) - odds(c, c_all)).alias("score"),
                          F.sqrt(F.greatest(g2, F.lit(0.0))).alias("z"))
            .filter((F.col("z") >= F.lit(z_min)) & (F.abs("score") >= F.lit(min_odds))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope by Newton's method, the slope lightly penalised."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + np.array([0, ridge]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic", held_out_mod: int = 5,
                   bits: int = BITS, prior: float = 0.02, z_min: float = 4.5,
                   min_odds: float = 1.0, drift: float = 0.05, max_e: float = 0.01,
                   fit_rows: int = 100_000) -> DataFrame:
    """_k (row key), doc_id, held_out, score, predicted, n_words, best, evidence,
    passages of every row. Trained on labelled ids whose crc32 is not 0 modulo
    ``held_out_mod``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       row_key(id_col, text_col).alias("_k"))
    known = written(labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("doc_id"))
             .agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
             .filter(crc_mod(F.col("doc_id"), held_out_mod) != 0), "known_labels")
    counts = written(_word_counts(rows, known, bits), "toxic_counts")
    sums = counts.agg(F.sum("t"), F.sum("c")).first()
    totals = {1: sums[0] or 0.0, 0: sums[1] or 0.0}
    model = ToxicModel(bits, np.zeros(0, np.int64), np.zeros(0), drift, 1.0, 0.1, max_e)
    if totals[0] and totals[1]:
        # at most 2^bits rows, in fact those far from no difference
        found = _log_odds(counts, totals, prior, z_min, min_odds).toPandas()
        model.buckets = found["bucket"].to_numpy(np.int64)
        model.scores = found["score"].to_numpy(float)
        # the clean distribution of scores, half an occurrence added to each
        shares = (found["c"].to_numpy(float) + 0.5) / totals[0]
        model.lam = karlin_lambda(np.append(model.scores, -drift),
                                  np.append(shares, max(1 - shares.sum(), 0.0)))
    shared = spark.sparkContext.broadcast(model)
    place = known.withColumn("in_train", F.lit(True))
    if place.count() <= BROADCAST_ROWS:
        place = F.broadcast(place)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = written(
        rows.select("_k", "doc_id", _buckets("text", bits).alias("buckets"))
        .join(place, "doc_id", "left")
        .select("_k", "doc_id", F.coalesce("in_train", F.lit(False)).alias("in_train"), "toxic",
                "buckets")
        .mapInArrow(lean(_scan(shared)), f"_k string, doc_id {kind}, in_train boolean, toxic int, n_words bigint, "
                    "n_segments bigint, best double, evidence double, passages array<struct<"
                    "first_word:bigint,last_word:bigint,score:double,e_value:double>>"),
        "toxic_scan")
    train = scanned.filter("in_train")
    total = train.count()
    if total:
        share = min(1.0, fit_rows / total)
        sample = (train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
                               < F.lit(int(share * (1 << 30))))
                  .select("evidence", "toxic").toPandas())
        y = sample["toxic"].to_numpy(float)
        if len(y) and 0 < y.mean() < 1:
            model.weights = fit_logistic(sample["evidence"].to_numpy(float), y)
        else:
            rate = totals[1] / max(totals[0] + totals[1], 1.0)
            model.weights = (30.0 if rate == 1 else -30.0, 0.0)
    else:
        model.weights = (-30.0, 0.0)
    a, b = model.weights
    score = F.lit(1.0) / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence"))))
    return (scanned.select("_k", "doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_out_mod) == 0,
                                                F.lit(False)).alias("held_out"),
                           score.alias("score"), "n_words", "best", "evidence", "passages")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", **options) -> DataFrame:
    """The documents not predicted toxic, all columns kept. Rows go one by one:
    another text of the same id, or of no id, stays."""
    bad = (score_toxicity(docs, labels, id_col, text_col, **options)
           .filter(F.col("predicted") == 1).select(F.col("_k").alias("_bad_key")).distinct())
    return docs.join(bad, row_key(id_col, text_col) == F.col("_bad_key"), "left_anti")
