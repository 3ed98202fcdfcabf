"""Dense indices packed into blocks of bounded size, dealt evenly to tasks.

A block is a range of consecutive indices. Its weights (rows of its entities,
plus one per entity) add up to at most the block size and the last entity's
own weight. Blocks carry labels whose Spark hash is the bucket they are dealt
to, so grouping by the label (or reading a table bucketed by it) gives every
task the same number of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import default_partitions, materialize, release

MAX_BUCKETS = 1 << 15  # tasks (and files of a bucketed table); they then hold several blocks
_TASK_ROWS = 1 << 20   # weight of the blocks that share a task
_CELLS = 4096          # cells of the index range, for finding a block by an equal join
_BROADCAST_ROWS = 1 << 19  # rows of the block table (about 40 bytes each) that are broadcast


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before it in
    ``order`` (unique). Sums run within range partitions, and the partitions'
    totals are added, so no task sees more than its partition."""
    spark = df.sparkSession
    ranged = (df.repartitionByRange(default_partitions(spark), order).sortWithinPartitions(order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "running")[0].withColumn("_part", F.shiftright("_mid", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    offsets = ranged.groupBy("_part").agg(F.sum(value).alias("_s")).select(
        "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(F.broadcast(offsets), "_part")
            .select(*df.columns, (F.col("_off") + F.col("_in")).cast("bigint").alias(out)))


def bucket_labels(spark: SparkSession, blocks: int, buckets: int) -> DataFrame:
    """``no, label``: distinct integers such that block ``no`` hashes to bucket
    ``no mod buckets`` (the hash of ``repartition`` and ``bucketBy``)."""
    each = math.ceil(blocks / buckets)
    tried = buckets * (2 * each + 8 * math.ceil(math.log(buckets + 1)) + 16)
    per_bucket = Window.partitionBy("p").orderBy("label")
    while True:
        label = F.col("id").cast("int")
        found = (spark.range(tried).select(label.alias("label"),
                                           F.pmod(F.hash(label), F.lit(buckets)).alias("p"))
                 .withColumn("r", F.row_number().over(per_bucket) - 1).filter(F.col("r") < each)
                 .select((F.col("r") * buckets + F.col("p")).cast("bigint").alias("no"), "label")
                 .filter(F.col("no") < blocks))
        found, n = materialize(found, "labels", count=True)
        if n == blocks:
            return found
        release(found)
        tried *= 2


@dataclass
class Packing:
    blocks: int
    buckets: int
    width: int        # indices per cell
    cells: int
    ranges: DataFrame  # cell, lo, hi, blk: a row per block and cell it overlaps

    def with_block(self, df: DataFrame, idx: str) -> DataFrame:
        """``df`` with ``blk``, the label of the block of ``idx``. The block table
        is broadcast while its size is bounded by ``_BROADCAST_ROWS``."""
        ranges = self.ranges
        if self.blocks + self.cells <= _BROADCAST_ROWS:
            ranges = F.broadcast(ranges)
        cell = F.least(F.floor(F.col(idx) / F.lit(self.width)), F.lit(self.cells - 1))
        return (df.withColumn("_cell", cell).join(ranges, "_cell")
                .filter((F.col(idx) >= F.col("_lo")) & (F.col(idx) < F.col("_hi")))
                .drop("_cell", "_lo", "_hi"))


def pack(weights: DataFrame, n: int, block_size: int) -> Packing:
    """Blocks over the indices 0 to ``n - 1``. ``weights``: e, n (rows), for
    those that have any. Indices from ``n`` on fall into the last block."""
    spark = weights.sparkSession
    n = max(n, 1)
    all_e = (spark.range(n).select(F.col("id").alias("e")).join(weights.select("e", "n"), "e", "left")
             .select("e", (F.coalesce("n", F.lit(0)) + 1).alias("w")))
    placed = running_sum(all_e, "e", "w", "before").withColumn(
        "no", F.floor(F.col("before") / F.lit(block_size)))
    bounds = placed.groupBy("no").agg(F.min("e").alias("_lo"), (F.max("e") + 1).alias("_hi"))
    bounds, blocks = materialize(bounds, "bounds", count=True)
    last_no = int(bounds.agg(F.max("no")).first()[0])
    # small blocks share a task: as many tasks as a shuffle has, more when they would
    # hold more than _TASK_ROWS; a task still holds one block at a time
    tasks = max(spark.sparkContext.defaultParallelism, default_partitions(spark),
                math.ceil(blocks * block_size / _TASK_ROWS))
    buckets = min(blocks, tasks, MAX_BUCKETS)
    if last_no + 1 != blocks:  # an entity longer than a block skips numbers
        from .prepare import rank_rows
        bounds = rank_rows(bounds.drop("no"), ["_lo"], "no")
    width = math.ceil(n / _CELLS)
    cells = math.ceil(n / width)
    hi = F.when(F.col("_hi") == F.lit(n), F.lit((1 << 63) - 1)).otherwise(F.col("_hi"))
    covered = F.explode(F.sequence(F.floor(F.col("_lo") / F.lit(width)),
                                   F.floor((F.col("_hi") - 1) / F.lit(width)))).alias("_cell")
    ranges, _ = materialize(bounds.join(bucket_labels(spark, blocks, buckets), "no").select(
        covered, "_lo", hi.alias("_hi"), F.col("label").alias("blk")), "blocks")
    return Packing(blocks, buckets, width, cells, ranges)
