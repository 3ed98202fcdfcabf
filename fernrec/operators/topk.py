"""Exact top-K with pruned item blocks.

Items are ordered by descending norm and cut into blocks. A score is at most
the product of the norms (Cauchy-Schwarz), so once a user has K candidates, a
block whose largest norm cannot reach the K-th of them holds nothing for that
user, nor does any later block. Blocks are taken in bands of 1, 1, 2, 4, ...
blocks; a user is sent only to the blocks of the band that may still matter,
and the K-th score is raised after every band. With norms as uneven as item
popularity makes them, most users close after a few bands; with equal norms
every block is scored, as ``scoring.recommend_topk`` does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, materialize_observed, release
from .prepare import rank_rows_counted
from .scoring import _MERGE_FANIN, _blocks, _given, _topk_kernel

_BOUNDS = 256       # norm bounds of a band that reach the driver
_SLACK = 1 + 1e-9   # more than the rounding of a score and of two norms
_BEST = "user_idx bigint, item_idx bigint, score double, rank bigint"


@dataclass
class PrunedTopK:
    frame: DataFrame  # user_idx, rank, item_idx, score
    blocks: int       # item blocks
    bands: int        # bands that had an open user
    scored: int       # (user, item block) cells scored
    skipped: int      # (user, item block) cells never scored


def _norm(vec: str):
    return F.sqrt(F.aggregate(vec, F.lit(0.0),
                              lambda a, x: a + x.cast("double") * x.cast("double")))


def _finite_norm(vec: str, what: str, idx: str):
    norm = _norm(vec)
    return F.when(norm < F.lit(float("inf")), norm).otherwise(F.raise_error(F.concat(
        F.lit(f"vector or score not finite for {what} "), F.col(idx).cast("string"))))


def _above(k: int):
    block_topk = _topk_kernel(k)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The block's top K of every user that reach the user's K-th score so far."""
        found = block_topk(left, right)
        users = left[left["kind"] == 0]
        least = pd.Series(users["s"].to_numpy(), index=users["user_idx"].to_numpy())
        return found[found["score"].to_numpy() >= found["user_idx"].map(least).to_numpy()]
    return run


def _best(candidates: DataFrame, k: int, two_levels: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("item_idx").asc()]
    if two_levels > 1:
        first = Window.partitionBy("user_idx", F.pmod("item_idx", F.lit(two_levels))).orderBy(*order)
        candidates = (candidates.withColumn("_r", F.row_number().over(first))
                      .filter(F.col("_r") <= F.lit(k)).drop("_r"))
    w = Window.partitionBy("user_idx").orderBy(*order)
    return (candidates.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= F.lit(k)).select("user_idx", "item_idx", "score", "rank"))


def recommend_pruned(users: DataFrame, train: DataFrame, p: DataFrame, q: DataFrame, k: int,
                     block_users: int = 4096, block_items: int = 8192) -> PrunedTopK:
    """Per user of ``users`` (``user_idx``, unique) the ``k`` best items not in train,
    by (score DESC, item index ASC): the rows of ``scoring.recommend_topk``.

    Fails for a user without a vector and for vectors that are not finite. Without
    users, items or with ``k`` < 1 the result is empty. Every band is written, so
    a lost executor redoes its tasks of one band.
    """
    spark = users.sparkSession
    if k < 1:
        return PrunedTopK(spark.createDataFrame([], _BEST), 0, 0, 0, 0)
    items = q.select(F.col("idx").alias("j"), F.col("vec").alias("qvec"),
                     _finite_norm("vec", "item", "idx").alias("norm"))
    items, n_items = rank_rows_counted(items.withColumn("_down", -F.col("norm")),
                                       ["_down", "j"], "pos")
    items = items.select(F.floor(F.col("pos") / F.lit(block_items)).cast("int").alias("ib"),
                         "j", "qvec", "norm")
    blocks = math.ceil(n_items / block_items)
    asked, n_users = materialize(
        users.select("user_idx").join(
            p.select(F.col("idx").alias("user_idx"), F.col("vec").alias("pvec")), "user_idx", "left")
        .withColumn("pvec", _given("pvec", "user", "user_idx"))
        .withColumn("pnorm", _finite_norm("pvec", "user", "user_idx")), "topk_users", count=True)
    seen, _ = materialize(
        train.join(users.select("user_idx"), "user_idx", "left_semi")
        .join(items.select(F.col("j").alias("item_idx"), "ib"), "item_idx")
        .select("user_idx", "ib", F.col("item_idx").alias("j")), "topk_train")

    best = spark.createDataFrame([], _BEST)
    lo, width, bands, scored = 0, 1, 0, 0
    while lo < blocks:
        hi = min(blocks, lo + width)
        band = F.col("ib").between(lo, hi - 1)
        step = math.ceil((hi - lo) / _BOUNDS)
        # one bound per ``step`` blocks, descending: at most _BOUNDS numbers
        bounds = [r["norm"] for r in items.filter(band).groupBy(
            F.floor((F.col("ib") - F.lit(lo)) / F.lit(step)).alias("at"))
            .agg(F.max("norm").alias("norm")).orderBy("at").collect()]
        least = best.filter(F.col("rank") == F.lit(k)).select("user_idx", F.col("score").alias("s"))
        s = F.coalesce("s", F.lit(float("-inf")))
        reach = F.size(F.filter(F.array(*[F.lit(b * _SLACK) for b in bounds]),
                                lambda b: F.col("pnorm") * b >= F.col("s")))
        open_, (n_open, cells) = materialize_observed(
            asked.join(least, "user_idx", "left").withColumn("s", s)
            .withColumn("end", F.least(F.lit(lo) + reach * F.lit(step), F.lit(hi)))
            .filter(F.col("end") > F.lit(lo)).select("user_idx", "pvec", "s", "end"),
            "topk_open", F.count(F.lit(1)), F.sum(F.col("end") - F.lit(lo)))
        if not n_open:  # norms only fall and K-th scores only rise
            release(open_)
            break
        bands, scored = bands + 1, scored + cells
        ub = F.pmod("user_idx", F.lit(_blocks(n_open, block_users))).cast("int").alias("ub")
        sent = open_.select(
            ub, F.explode(F.sequence(F.lit(lo), F.col("end") - F.lit(1))).alias("ib"),
            F.lit(0).alias("kind"), "user_idx", F.lit(-1).cast("bigint").alias("j"), "s", "pvec")
        masked = (seen.filter(band).join(open_.select("user_idx", "end"), "user_idx")
                  .filter(F.col("ib") < F.col("end"))
                  .select(ub, "ib", F.lit(1).alias("kind"), "user_idx", "j",
                          F.lit(None).cast("double").alias("s"),
                          F.lit(None).cast(open_.schema["pvec"].dataType).alias("pvec")))
        # an item block is copied only to the user blocks that still ask for it
        cells = sent.select(F.col("ub").alias("cell_ub"), F.col("ib").alias("cell_ib")).distinct()
        right = (items.filter(band).join(cells, F.col("ib") == F.col("cell_ib"))
                 .select(F.col("cell_ub").alias("ub"), F.col("cell_ib").alias("ib"), "j", "qvec"))
        found = (sent.unionByName(masked).groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib"))
                 .applyInPandas(_above(k), "user_idx bigint, item_idx bigint, score double"))
        levels = math.isqrt(hi - lo) if hi - lo > _MERGE_FANIN else 1
        before = best
        best, _ = materialize(
            _best(found.unionByName(best.select("user_idx", "item_idx", "score")), k, levels),
            "topk_best")
        release(before)
        release(open_)
        lo, width = hi, hi
    release(asked)
    release(seen)
    return PrunedTopK(best.select("user_idx", "rank", "item_idx", "score"), blocks, bands, scored,
                      n_users * blocks - scored)
