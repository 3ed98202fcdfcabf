"""The k-core by peeling on an indexed adjacency.

A small table is rewritten in every round (one job). Beyond
that, the first round scans the interactions, which are then written twice, laid out in buckets of the user and in buckets of the item. From
there on a round only reads the buckets of the keys that die in it: the rows of
a dying key are found through its own side's index, counted per key of the
other side, and subtracted there. What a round writes are the counts it changed
(a delta table per side, newest count = smallest), so rounds read rows in
proportion to what they remove, and shuffle only the changed counts: the first
counts are bucketed by their key and stay where they are, and rows meet the dying
keys where they are read. Few keys are broadcast; many are broadcast as one bit per
hash, and the rows that pass are shuffled to the exact join.

Rows that are gone stay in the index: a row of a dying key and a living one is
alive, and the counts of dead keys are not looked at. Only a first round that
removes most rows writes its survivors instead.

A bucket holds about ``rows_per_bucket`` rows (more beyond ``MAX_BUCKETS``
buckets); the rows of a key with more are
dealt by the other side's key to as many tasks as they need when the index is
written, so a key with a third of all rows is written and read by many tasks.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import (default_partitions, materialize, materialize_observed, release,
                       write_partitioned)

ROWS_PER_BUCKET = 1 << 16
MAX_BUCKETS = 1 << 14  # beyond, buckets grow
SCAN_ROWS = 1 << 18  # rows per shuffle partition up to which rounds scan
MAX_SCAN_ROWS = 1 << 20  # rows in all: beyond, a round that rewrites them moves too much
_DELTAS = 8  # delta tables of a side before they are merged
_BROADCAST_KEYS = 1 << 17  # keys that are broadcast as they are
_SLOTS = 1 << 24  # bits of the broadcast filter for more keys (2 MB, in rows of 64)


class KCoreLimitError(RuntimeError):
    """The caller's round limit ran out before the fixpoint."""


@dataclass
class KCoreResult:
    interactions: DataFrame
    rounds: int
    counts: list[int]
    #: (round, buckets read, buckets of the index) of every look-up in an index
    buckets_read: list[tuple[int, int, int]] = field(default_factory=list)


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _slot(key: str):
    return F.pmod(F.xxhash64(key), F.lit(_SLOTS))


def _key_bits(keys: DataFrame, key: str) -> DataFrame:
    """``_word, _bits``: a bit per hash of ``keys``; at most _SLOTS / 64 rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(_slot(key), F.lit(64)).cast("int"))
    return keys.select(F.shiftright(_slot(key), 6).alias("_word"), bit.alias("_bit")).groupBy(
        "_word").agg(F.bit_or("_bit").alias("_bits"))


def _hit(rows: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: whether the hash of ``key`` is one of ``keys``' (false
    hits only); moves no rows."""
    words = F.broadcast(_key_bits(keys, key))
    bit = F.getbit("_bits", F.pmod(_slot(key), F.lit(64)).cast("int"))
    return (rows.withColumn("_word", F.shiftright(_slot(key), 6)).join(words, "_word", "left")
            .withColumn(out, F.coalesce(bit, F.lit(0)) == 1).drop("_word", "_bits"))


def _with_keys(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``keys`` (at most ``n``)."""
    if n <= _BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), key, "left_semi")
    if n <= _SLOTS:
        rows = _hit(rows, key, keys, "_hit").filter("_hit").drop("_hit")
    return rows.join(keys, key, "left_semi")


def _without_keys(rows: DataFrame, gone: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """The rows of none of the ``gone`` (column, keys, number of keys)."""
    for key, keys, n in gone:
        if n <= _BROADCAST_KEYS:
            rows = rows.join(F.broadcast(keys), key, "left_anti")
    gone = [g for g in gone if g[2] > _BROADCAST_KEYS]
    maybe = F.lit(False)
    if not gone or max(n for *_, n in gone) > _SLOTS // 4:  # most bits would be set
        kept = None
    else:
        for key, keys, _ in gone:
            rows = _hit(rows, key, keys, f"_hit_{key}")
            maybe = maybe | F.col(f"_hit_{key}")
        kept, rows = rows.filter(~maybe), rows.filter(maybe)
    for key, keys, _ in gone:
        rows = rows.join(keys, key, "left_anti")
    return rows if kept is None else kept.unionByName(rows)


class _Side:
    """One side's keys: least count, current counts, rows indexed by key."""

    def __init__(self, key: str, other: str, least: int):
        self.key, self.other, self.least = key, other, least
        # key, _n, bucketed by key, then the changes; the newest count is the smallest
        self.counts: list[DataFrame] = []
        self.dying: DataFrame | None = None  # key (those below ``least`` with rows left)
        self.n_dying = 0                     # their number at most
        self.buckets: list[int] = []         # that the dying keys lie in
        self.rows: DataFrame | None = None
        self.n_buckets = 0                   # 0: ``rows`` is the unindexed table
        self.peeled = False
        self.scratch: list[DataFrame] = []

    def current(self) -> DataFrame:
        if len(self.counts) == 1:
            return self.counts[0]
        every = functools.reduce(DataFrame.unionByName, self.counts)
        return every.groupBy(self.key).agg(F.min("_n").alias("_n"))

    def dead(self) -> DataFrame:
        """Keys whose rows are off the other side's counts."""
        low = self.current().filter(F.col("_n") < F.lit(self.least)).select(self.key)
        return low if self.dying is None else low.join(self.dying, self.key, "left_anti")

    def is_low(self):
        return (F.col("_n") < F.lit(self.least)) & (F.col("_n") > 0)

    def note(self, counts: DataFrame) -> None:
        """Take newer counts (key, _n) of some keys."""
        self.counts.append(counts)
        if len(self.counts) > _DELTAS + 1:
            every = functools.reduce(DataFrame.unionByName, self.counts[1:])
            merged = materialize(every.groupBy(self.key).agg(F.min("_n").alias("_n")), "degrees")[0]
            self.scratch.append(merged)
            self.counts = [self.counts[0], merged]

    def add_counts(self, rows: DataFrame, *extra) -> int:
        """Write new counts (key, _n, ...) and note the keys that die by them;
        returns the sum ``extra`` of the written rows."""
        # bucket numbers only: bounded by the number of buckets
        found = F.collect_set(F.when(self.is_low(), _bucket(self.key, max(self.n_buckets, 1))))
        first = not self.counts
        table, (n_low, buckets, *sums) = materialize_observed(
            rows, "degrees", F.count_if(self.is_low()), found, *extra,
            bucket_by=self.key if first else None)
        self.scratch.append(table)
        self.note(table.select(self.key, "_n"))
        self.n_dying = n_low if self.peeled or first else self.n_dying + n_low
        if self.peeled or first:
            self.dying = table.filter(self.is_low()).select(self.key) if n_low else None
        else:  # the side's first turn is to come: keys low from the start die, too
            self.dying = self.current().filter(self.is_low()).select(self.key)
        self.buckets = sorted(buckets or [])
        return sums[0] if sums else 0

    def rows_of(self, dying: DataFrame) -> DataFrame:
        rows = self.rows
        if self.n_buckets and len(self.buckets) < self.n_buckets:
            rows = rows.filter(F.col("_bucket").isin(self.buckets))
        return _with_keys(rows, self.key, dying, self.n_dying)

    def build_index(self, rows: DataFrame, n_rows: int, rows_per_bucket: int) -> None:
        """Write ``rows`` in buckets of this side's key. Keys with more rows than
        a bucket should hold (at most as many as there are buckets) are spread."""
        rows_per_bucket = max(rows_per_bucket, math.ceil(n_rows / MAX_BUCKETS))
        self.n_buckets = max(1, math.ceil(n_rows / rows_per_bucket))
        spread = F.lit(0)
        # by the first counts: rows that are gone may be in the index
        hot = self.counts[0].filter(F.col("_n") > F.lit(rows_per_bucket)).select(
            self.key, F.ceil(F.col("_n") / F.lit(rows_per_bucket)).alias("_spread"))
        cols = rows.columns
        if self.n_buckets > 1 and not hot.isEmpty():
            rows = rows.join(F.broadcast(hot), self.key, "left")
            spread = F.coalesce(F.pmod(F.xxhash64(self.other), F.col("_spread")), F.lit(0))
        spark = rows.sparkSession
        rows = rows.select(*cols, _bucket(self.key, self.n_buckets).alias("_bucket"),
                           spread.alias("_spread"))
        # few buckets: their rows are split so that every core has a part
        parts = default_partitions(spark)
        pieces = max(1, parts // self.n_buckets)
        dealt = rows.repartition(parts, "_bucket", "_spread",
                                 F.pmod(F.xxhash64(self.key), F.lit(pieces))).drop("_spread")
        self.rows = write_partitioned(dealt, f"{self.key}_adjacency", "_bucket")
        self.scratch.append(self.rows)

    def release(self) -> None:
        for df in self.scratch:
            release(df)


def _limit(rounds: int, counts: list[int]) -> KCoreLimitError:
    return KCoreLimitError(f"no core after {rounds} rounds: rows per round {counts}")


def _scan_rounds(table: DataFrame, own: bool, n: int, sides: tuple, max_rounds: int | None
                 ) -> KCoreResult:
    """The rounds on a table that one wave of tasks scans: each counts and
    rewrites the rows left, in one job."""
    counts, rounds, first = [n], 0, table
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise _limit(rounds, counts)
        rows = table
        for key, least in sides:
            kept = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(
                F.col("_n") >= F.lit(least))
            rows = rows.join(kept.select(key), key, "left_semi") if least > 1 else rows
        smaller, left = materialize(rows.select(*table.columns), "kcore", count=True)
        rounds += 1
        counts.append(left)
        if left == counts[-2]:  # nothing went: the round's input is the core
            release(smaller)
            return KCoreResult(table, rounds, counts)
        if own or table is not first:
            release(table)
        table = smaller


def k_core(interactions: DataFrame, min_user: int, min_item: int,
           max_rounds: int | None = None, user_col: str = "user_id", item_col: str = "item_id",
           input_count: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
           scan_rows: int | None = None) -> KCoreResult:
    """Repeat (users first, then items) until a round removes nothing.

    Rounds go on to the fixpoint however many it takes; with ``max_rounds`` a
    core that is not reached by then raises ``KCoreLimitError`` (never a
    non-core). Pass ``input_count`` when ``interactions`` is already a written
    table (it is then read as is). All tables go to the shared checkpoint folder.
    Up to ``scan_rows`` rows (by default SCAN_ROWS per shuffle partition, at most
    MAX_SCAN_ROWS) every round rewrites the rows left; beyond that they are indexed
    after the first.
    """
    if input_count is None:
        table, n = materialize(interactions, "kcore_input", count=True)
    else:
        table, n = interactions, input_count
    own = input_count is None
    cols = table.columns
    if scan_rows is None:
        scan_rows = min(default_partitions(table.sparkSession) * SCAN_ROWS, MAX_SCAN_ROWS)
    if n <= scan_rows:
        return _scan_rounds(table, own, n, ((user_col, min_user), (item_col, min_item)), max_rounds)
    users, items = _Side(user_col, item_col, min_user), _Side(item_col, user_col, min_item)
    for side in (users, items):
        side.rows = table
        side.add_counts(table.groupBy(side.key).agg(F.count(F.lit(1)).alias("_n")))

    def changes(side: _Side, dying: DataFrame, other: _Side) -> DataFrame:
        """The other side's counts without the rows of ``dying``: key, _n, _lost."""
        found = (side.rows_of(dying).groupBy(other.key).agg(F.count(F.lit(1)).alias("_lost")))
        # bucketed as ``found`` is grouped: only the changes are moved
        counts = other.counts[0].join(found.hint("shuffle_hash"), other.key)
        if len(other.counts) > 1:
            later = functools.reduce(DataFrame.unionByName, other.counts[1:])
            counts = counts.unionByName(later.join(found, other.key)).groupBy(other.key).agg(
                F.min("_n").alias("_n"), F.max("_lost").alias("_lost"))
        # a key that is dead has lost these rows before (keys low from the
        # start are not dead before their side's first turn)
        alive = F.col("_n") >= F.lit(other.least) if other.peeled else F.col("_n") > 0
        return counts.filter(alive).select(
            other.key, (F.col("_n") - F.col("_lost")).alias("_n"), "_lost")

    def peel(side: _Side, other: _Side) -> int:
        """One side's turn; returns the rows it removes."""
        rows = changes(side, side.dying, other)
        if side.n_buckets:
            buckets_read.append((rounds + 1, len(side.buckets), side.n_buckets))
        side.dying, side.peeled = None, True
        return other.add_counts(rows, F.sum("_lost"))

    def alive(rows: DataFrame) -> DataFrame:
        gone = []
        for side in (users, items):
            dead, n_dead = materialize(side.dead(), "dead", count=True)
            side.scratch.append(dead)
            gone.append((side.key, dead, n_dead))
        return _without_keys(rows, gone).select(*cols)

    counts, rounds, left, buckets_read = [n], 0, n, []
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise _limit(rounds, counts)
        for side, other in ((users, items), (items, users)):
            if side.dying is not None:
                left -= peel(side, other)
            side.peeled = True
        rounds += 1
        counts.append(left)
        if left == counts[-2]:
            break
        if rounds == 1 and left:
            few = 2 * left < n
            for side in (users, items):
                rows = table if not few else alive(table) if side is users else users.rows
                # only the users' rows are read whole again
                side.build_index(rows.select(*(cols if side is users else (user_col, item_col))),
                                 left, rows_per_bucket)
                if side.dying is not None:
                    side.buckets = [r["b"] for r in side.dying.select(
                        _bucket(side.key, side.n_buckets).alias("b")).distinct().collect()]
    if left == n and not own:
        core = table
    else:
        core = materialize(alive(users.rows if users.n_buckets else table), "kcore")[0]
        if own:
            release(table)
    for side in (users, items):
        side.release()
    return KCoreResult(core, rounds, counts, buckets_read)
