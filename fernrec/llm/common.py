"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import default_partitions, materialize
from ..sources.tables import table_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def whole_text(col: Column | str) -> Column:
    """The text, with null read as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def row_key(id_col: Column | str, text_col: Column | str) -> Column:
    """A key that is never null and tells rows apart that share an id but not
    the text (null and empty texts differ)."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.concat_ws("|", F.coalesce(ident.cast("string"), F.lit("null")),
                       F.coalesce(F.md5(text.cast("string")), F.lit("null")))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its
    lineage is cut there and several readers share one computation."""
    return materialize(df, name)[0]


def written_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As ``written``, with the number of rows, counted by the same job."""
    out, n = materialize(df, name, count=True)
    return out, int(n or 0)


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` written in (``group``, ``order``) order, with two columns per
    entry of ``sums`` (expressions that are never null): ``before_<name>``, the
    sum over the earlier rows of the row's group, and ``all_<name>``, the sum
    over its whole group.

    No group has to fit a task: rows are range-partitioned, a window only covers
    a group's rows of one partition, and the partitions' totals (one row per
    group and partition) are joined back. ``group`` is never null. Rows equal in
    all of ``order`` are told apart by their place in the input.
    """
    spark = df.sparkSession
    ranged = (df.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(default_partitions(spark), group, *order, "_tie")
              .sortWithinPartitions(group, *order, "_tie").drop("_tie")
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = written(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33))
    totals = ranged.groupBy(group, "_part").agg(
        *[F.sum(expr).alias(f"all_{name}") for name, expr in sums.items()])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    totals = totals.select(
        group, "_part",
        *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"all_{n}").over(whole).alias(f"all_{n}") for n in sums])
    inside = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(expr).over(inside), F.lit(0)).alias(f"_in_{n}")
                                for n, expr in sums.items()]).join(totals, [group, "_part"])
    return rows.select(
        *df.columns, *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).cast("bigint").alias(f"before_{n}")
                       for n in sums],
        *[F.col(f"all_{n}").cast("bigint").alias(f"all_{n}") for n in sums])


HOT_SHARE = 1000


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, n_rows: str) -> DataFrame:
    """``rows`` (a written table) joined with the one row of ``per_key`` (a
    written table, too) of its key; ``n_rows`` is the key's number of rows.

    Keys that hold a thousandth of all rows or more, at most a thousand of them,
    are broadcast, so no hot key meets in one task; the others are shuffled.
    ``key`` is never null.
    """
    total = per_key.agg(F.sum(n_rows)).first()[0] or 0
    is_hot = F.col(n_rows) * HOT_SHARE >= F.lit(int(total))
    hot = rows.join(F.broadcast(per_key.filter(is_hot)), key)
    if per_key.filter(~is_hot).isEmpty():
        return hot
    return hot.unionByName(rows.join(per_key.filter(~is_hot), key))


def give_back() -> None:
    """Return this worker's freed memory to the system. Workers are reused, and
    an idle one keeps what its allocators hold beside the next task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(stream: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``stream`` (a function for mapInArrow or mapInPandas) that gives freed
    memory back after every batch and at its end."""
    def run(batches: Iterator) -> Iterator:
        for out in stream(batches):
            yield out
            del out
            give_back()
        give_back()
    return run
