"""Item missing-data weights (A4, M1) and interaction histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_popularity(train: DataFrame) -> DataFrame:
    """A4: train interactions per item (test rows are never counted)."""
    return train.groupBy("item_idx").agg(F.count(F.lit(1)).alias("n"))


def item_weights(train: DataFrame, c0: float, alpha: float) -> DataFrame:
    """M1: ``c_i = c0 * f_i^alpha / sum_j f_j^alpha`` with ``f_i = n_i / sum n``.

    The total cancels, so ``c_i = c0 * n_i^alpha / sum_j n_j^alpha``; the sum
    is a one-row aggregate read back as a scalar. Only items seen in train
    get a row (absent = weight 0); weights sum to ``c0``.
    Returns ``item_idx BIGINT, c DOUBLE``.
    """
    return weights_from_counts(item_popularity(train), c0, alpha)


def weights_from_counts(counts: DataFrame, c0: float, alpha: float) -> DataFrame:
    """M1 from per-item train counts ``item_idx, n`` (one row per item; pass
    a written table to aggregate train only once)."""
    total = counts.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(float(alpha))))).first()[0]
    if not total:
        return counts.select("item_idx", F.lit(0.0).alias("c")).limit(0)
    scale = float(c0) / float(total)
    return counts.select(
        "item_idx",
        (F.lit(scale) * F.pow(F.col("n").cast("double"), F.lit(float(alpha)))).alias("c"))


def all_item_weights(item_index: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights for every indexed item, 0.0 for items without train rows."""
    return (item_index.select("item_idx").join(weights, "item_idx", "left")
            .select("item_idx", F.coalesce("c", F.lit(0.0)).alias("c")))


def histories(train: DataFrame, weights: DataFrame) -> DataFrame:
    """Train pairs carrying the item weight: ``user_idx, item_idx, c``.

    This one relation is both the user history (grouped by user) and the
    item history (grouped by item). It is never collected into one array per
    key: the update kernels read it in blocks, and very long histories are
    reduced through partial sums (see ``operators.halfstep``).
    """
    return train.join(weights, "item_idx").select("user_idx", "item_idx", "c")


def history_summary(hist: DataFrame, key: str) -> DataFrame:
    """Per-key history length and weight sum (the A6/A7 counts)."""
    return hist.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("sum_c"))
