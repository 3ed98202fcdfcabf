"""Preparation operators: dedup, k-core, dense index, leave-one-out split.

All are DataFrame plans. Grouped counts and maxima aggregate partially
(map-side) before their shuffle, so a user or item holding a large share of
all rows is pre-combined in every task instead of landing whole in one.
Filters are semi joins against the surviving keys: AQE turns them into
broadcast joins when the key set measured at run time is small, and splits
skewed partitions (``spark.sql.adaptive.skewJoin``) otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_partitions, materialize
from .hotjoin import lookup
from .kcore import KCoreLimitError, KCoreResult, k_core  # noqa: F401 - part of this module's API


def dedup_latest(interactions: DataFrame) -> DataFrame:
    """A1: one row per (user_id, item_id) with the latest timestamp."""
    return interactions.groupBy("user_id", "item_id").agg(F.max("ts").alias("ts"))


def keys_with_min_count(df: DataFrame, key: str, min_count: int) -> DataFrame:
    """A2/A3 + F2: keys with at least ``min_count`` rows (inclusive)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= F.lit(min_count)).select(key))


def filter_min_count(df: DataFrame, key: str, min_count: int) -> DataFrame:
    """F3/F4 (J1/J2): keep rows whose ``key`` has at least ``min_count`` rows."""
    if min_count <= 1:
        return df  # every present key already has one row
    return df.join(keys_with_min_count(df, key, min_count), key, "left_semi")


def filter_user_min_count(df: DataFrame, min_count: int, user_col: str = "user_id") -> DataFrame:
    return filter_min_count(df, user_col, min_count)


def filter_item_min_count(df: DataFrame, min_count: int, item_col: str = "item_id") -> DataFrame:
    return filter_min_count(df, item_col, min_count)


def rank_rows(df: DataFrame, order_cols: list[str], rank_col: str,
              num_partitions: int | None = None) -> DataFrame:
    """See ``rank_rows_counted``; returns the frame only."""
    return rank_rows_counted(df, order_cols, rank_col, num_partitions)[0]


def rank_rows_counted(df: DataFrame, order_cols: list[str], rank_col: str,
                      num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """0-based position of each row in ascending ``order_cols`` order.

    Same result as ``row_number() OVER (ORDER BY ...) - 1`` for a unique
    order, without funnelling rows through one task: range partition, sort
    within partitions, count per partition, prefix-sum the (few) counts, add
    the offset. The ranged rows are written once so that both passes see the
    same range bounds.
    """
    spark = df.sparkSession
    n = num_partitions or default_partitions(spark)
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged, n_rows = materialize(ranged, "ranked", count=True)
    part = F.shiftright("_mid", 33)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per range partition: size bounded by n, so broadcast is safe
    offsets = (ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.sum("_n").over(
                   Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
               .select("_part", F.coalesce("_off", F.lit(0)).alias("_off")))
    ranked = (ranged.join(F.broadcast(offsets), part == F.col("_part"))
              .withColumn(rank_col, (F.col("_off") + pos).cast("bigint"))
              .drop("_mid", "_part", "_off"))
    return ranked, n_rows


def dense_index(df: DataFrame, id_col: str, idx_col: str,
                num_partitions: int | None = None) -> DataFrame:
    """W1 (+A5): dense 0-based index of the distinct ids in ascending order."""
    return dense_index_counted(df, id_col, idx_col, num_partitions)[0]


def dense_index_counted(df: DataFrame, id_col: str, idx_col: str,
                        num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """``dense_index`` and the number of distinct ids (counted in its write).

    The index is a pure function of a written table (ranked ids plus the
    broadcast per-partition offsets), so it need not be written again."""
    ids = df.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    return rank_rows_counted(ids, [id_col], idx_col, num_partitions)


# A top-n keeps n rows per task and merges tasks x n rows in one task; up to
# this many merged rows it is used, beyond it a distributed global rank.
TOP_N_MERGE_LIMIT = 100_000


def first_n(df: DataFrame, order_cols: list[str], n: int, pos_col: str = "pos",
            tasks: int | None = None) -> DataFrame:
    """The first ``n`` rows in ascending ``order_cols`` order (a unique order)
    with their 0-based position; the size of the result is the feature.

    ``tasks`` is the number of input tasks of ``df`` when the caller knows it
    (a plain scan); otherwise the shuffle width is taken as the estimate.
    """
    if tasks is None:
        tasks = default_partitions(df.sparkSession)
    if n * max(tasks, 1) <= TOP_N_MERGE_LIMIT:
        top = df.orderBy(*order_cols).limit(n)
        # at most n rows reach this window (bounded by the requested size)
        w = Window.orderBy(*order_cols)
        return top.withColumn(pos_col, (F.row_number().over(w) - 1).cast("bigint"))
    return rank_rows(df, order_cols, pos_col).filter(F.col(pos_col) < F.lit(n))


@dataclass
class Indexed:
    interactions: DataFrame  # user_idx, item_idx, ts
    user_index: DataFrame    # user_id, user_idx
    item_index: DataFrame    # item_id, item_idx
    num_users: int = 0
    num_items: int = 0


def index_interactions(interactions: DataFrame, num_partitions: int | None = None) -> Indexed:
    """W1 twice + J3/J4: replace string ids by dense indices; hot ids take a
    broadcast of their few index rows (``operators.hotjoin``)."""
    users, n_users = dense_index_counted(interactions, "user_id", "user_idx", num_partitions)
    items, n_items = dense_index_counted(interactions, "item_id", "item_idx", num_partitions)
    indexed = lookup(interactions, {"user_id": users, "item_id": items}).select(
        "user_idx", "item_idx", "ts")
    return Indexed(indexed, users, items, n_users, n_items)


@dataclass
class Split:
    train: DataFrame  # user_idx, item_idx
    test: DataFrame   # user_idx, test_item_idx, n_train


def leave_one_out(indexed: DataFrame) -> Split:
    """Per user the latest (ts, item_idx) row is the test item.

    Ties on ``ts`` go to the larger item index (= larger string id). The
    latest row is a partial (map-side) maximum per user, so a user with a
    huge history never needs one sorted window; train is the anti join on
    the (user, item) pair, which spreads such a user over all tasks.

    When ``(ts - min ts) * items + item_idx`` fits in 62 bits (ranges from
    one small aggregate), the maximum is over that long (hash aggregation);
    otherwise over the struct ``(ts, item_idx)`` (sort-based aggregation).
    """
    bounds = indexed.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"),
                         F.min("item_idx").alias("i_lo"), F.max("item_idx").alias("i_hi")).first()
    packed = (bounds is not None and bounds["lo"] is not None and bounds["i_lo"] >= 0
              and (bounds["hi"] - bounds["lo"] + 1) * (bounds["i_hi"] + 1) < (1 << 62))
    if packed:
        width = F.lit(int(bounds["i_hi"]) + 1)
        key = (F.col("ts") - F.lit(int(bounds["lo"]))) * width + F.col("item_idx")
        latest = indexed.groupBy("user_idx").agg(F.max(key).alias("_last"),
                                                 F.count(F.lit(1)).alias("_n"))
        test_item = F.pmod(F.col("_last"), width)
    else:
        latest = indexed.groupBy("user_idx").agg(
            F.max(F.struct("ts", "item_idx")).alias("_last"),
            F.count(F.lit(1)).alias("_n"))
        test_item = F.col("_last.item_idx")
    test = latest.select(
        "user_idx",
        test_item.cast("bigint").alias("test_item_idx"),
        (F.col("_n") - 1).alias("n_train"))
    return Split(train_without_test(indexed, test), test)


def train_without_test(indexed: DataFrame, test: DataFrame) -> DataFrame:
    """Train pairs: every (user, item) except the held-out one (anti join on
    the pair, so a long history spreads over all tasks; the held-out pairs, one
    per user, are hashed, so the interactions are not sorted)."""
    held = test.select("user_idx", F.col("test_item_idx").alias("item_idx")).hint("shuffle_hash")
    return indexed.select("user_idx", "item_idx").join(held, ["user_idx", "item_idx"], "left_anti")

