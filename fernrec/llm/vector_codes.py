"""Operator 11: vector code compression with Hilbert-sorted flat blocks.

Vectors of integers floor(scale * x) are cut into ``PARTS`` equal consecutive
parts, and every part position gets a codebook of ``ENTRIES`` entries by exact
Lloyd rounds. A task packs its vectors into groups; within a group, the
vectors' pieces at each part position are sorted along a Hilbert curve and cut
into flat blocks of ``BLOCK`` neighbours that keep their box (componentwise
minimum and maximum) and sum. In a round an entry stays on a block's shortlist
unless it is farther from the whole box than another entry is from the box's
farthest corner, or than the entry nearest to the block's mean at every corner.
A block with one entry left is counted by its stored sum and
size; the others' rows are measured against their shortlist in integers. A task
emits one sum per part and entry, so a round moves nothing else, and codebooks
(entries x components) are all the driver holds.

The result is that of measuring every piece against every entry: distances are
exact, ties go to the lower index, means are floored, unused entries stay.

Edge cases: a null vector, and one with a null or non-finite component, is
dropped; null ids come last among the starting entries and keep their row;
equal ids are rows of their own; with fewer kept rows than entries, the codebook
has that many entries; an empty table gives no rows; extra columns are ignored.
Vectors of unlike lengths, lengths that PARTS does not divide, and components
whose squared distances would not fit a long raise an error that says so.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import join_by_key, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 16
#: Components held in one group of vectors, a row of the packed table.
GROUP_VALUES = 1 << 19


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of ``points`` (n x d, values of ``bits`` bits, d * bits
    at most 62) along the d-dimensional Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the highest bit down
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for i in range(d):
            key = key << 1 | (x[i] ^ flip) >> bit & 1
    return key


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """An order of the rows along a Hilbert curve of as many bits as fit; beyond
    62 components those with the largest spread count."""
    if not points.shape[1]:
        return np.arange(len(points))
    lo, hi = points.min(axis=0), points.max(axis=0)
    used = np.sort(np.argsort(lo - hi, kind="stable")[:62])
    bits = min(62 // len(used), 16)
    spread = np.maximum(hi - lo, 1)[used].astype(np.float64)
    cells = ((points[:, used] - lo[used]) / spread * ((1 << bits) - 1)).astype(np.int64)
    return np.argsort(hilbert_keys(cells, bits), kind="stable")


class Blocks:
    """The flat blocks of one part position within a group."""

    def __init__(self, flat: np.ndarray, perm: np.ndarray, low: np.ndarray, high: np.ndarray,
                 sums: np.ndarray, block: int):
        self.flat, self.perm, self.low, self.high, self.sums = flat, perm, low, high, sums
        starts = np.arange(0, len(flat), block)
        self.sizes = np.minimum(block, len(flat) - starts)

    @classmethod
    def build(cls, points: np.ndarray, block: int) -> "Blocks":
        perm = hilbert_order(points)
        flat = points[perm]
        starts = np.arange(0, len(flat), block)
        return cls(flat, perm, np.minimum.reduceat(flat, starts), np.maximum.reduceat(flat, starts),
                   np.add.reduceat(flat, starts), block)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """blocks x entries: the entries that may be nearest to a row."""
        near = np.empty((len(self.low), len(entries)), np.int64)
        far = np.empty_like(near)
        for k, entry in enumerate(entries):
            below, above = self.low - entry, entry - self.high
            near[:, k] = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
            far[:, k] = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
        listed = near <= far.min(axis=1)[:, None]
        # against the entry nearest to the block's mean, the difference of the
        # two distances is linear, so its bound over the box is exact
        mean = self.sums // self.sizes[:, None]
        own = np.stack([((mean - entry) ** 2).sum(axis=1) for entry in entries], axis=1).argmin(axis=1)
        best = entries[own]
        base = (best ** 2).sum(axis=1)
        for k, entry in enumerate(entries):
            slope = 2 * (entry - best)
            most = base - (entry ** 2).sum() + np.where(
                slope > 0, slope * self.high, slope * self.low).sum(axis=1)
            listed[:, k] &= (most > 0) | ((most == 0) & (own >= k)) | (own == k)
        return listed

    def _nearest(self, listed: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest listed entry and distance of the rows, in block order.
        Rows of blocks without a listed entry get -1."""
        best = np.full(len(self.flat), np.iinfo(np.int64).max)
        code = np.full(len(self.flat), -1)
        for k, entry in enumerate(entries):
            rows = np.nonzero(np.repeat(listed[:, k], self.sizes))[0]
            if len(rows):
                gap = self.flat[rows] - entry
                dist = np.einsum("ij,ij->i", gap, gap)
                closer = dist < best[rows]
                best[rows[closer]] = dist[closer]
                code[rows[closer]] = k
        return code, best

    def sums_by_entry(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows per entry and the sums of their components."""
        listed = self.shortlists(entries)
        alone = listed.sum(axis=1) == 1
        counts = np.zeros(len(entries), np.int64)
        sums = np.zeros(entries.shape, np.int64)
        only = listed[alone].argmax(axis=1)
        np.add.at(counts, only, self.sizes[alone])
        np.add.at(sums, only, self.sums[alone])
        code, _ = self._nearest(listed & ~alone[:, None], entries)
        rest = np.nonzero(code >= 0)[0]
        np.add.at(counts, code[rest], 1)
        order = rest[np.argsort(code[rest], kind="stable")]
        if len(order):
            found, first = np.unique(code[order], return_index=True)
            sums[found] += np.add.reduceat(self.flat[order], first)
        return counts, sums

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row, in the group's row order."""
        code, best = self._nearest(self.shortlists(entries), entries)
        out, dist = np.empty_like(code), np.empty_like(best)
        out[self.perm], dist[self.perm] = code, best
        return out, dist


def _scaled(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) of the vectors, one row each."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unlike lengths cannot share codebooks")
    if len(sizes) and sizes[0] % parts:
        raise ValueError(f"vectors of {sizes[0]} components cannot be cut into {parts} equal parts")
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    dims = int(sizes[0]) if len(sizes) else 0
    # every bound below stays under 16 m^2 * dims, which must fit a long
    if len(values) and np.abs(values).max() >= math.sqrt(2.0 ** 58 / dims):
        raise ValueError("components are too large for exact distances in a long")
    return values.astype(np.int64).reshape(len(sizes), dims)


def _pack(scale: int, parts: int, block: int, group_values: int):
    def emit(ids: list, labels: list, points: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        dims = points.shape[1] // parts
        made = [Blocks.build(points[:, p * dims:(p + 1) * dims], block) for p in range(parts)]

        def joined(name: str, kind) -> bytes:
            return np.concatenate([getattr(b, name).ravel() for b in made]).astype(kind).tobytes()
        small = np.abs(points).max() < 1 << 15 if points.size else True
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(schema.field("vec_id").type)),
             pa.array([labels], pa.list_(schema.field("label").type)),
             pa.array([len(points)], pa.int32()), pa.array([dims], pa.int32()),
             pa.array([2 if small else 8], pa.int32()),
             pa.array([joined("flat", np.int16 if small else np.int64)], pa.binary()),
             pa.array([joined("perm", np.int32)], pa.binary()),
             pa.array([joined("low", np.int16 if small else np.int64)], pa.binary()),
             pa.array([joined("high", np.int16 if small else np.int64)], pa.binary()),
             pa.array([joined("sums", np.int64)], pa.binary())],
            names=["ids", "labels", "n", "dims", "width", "flat", "perm", "low", "high", "sums"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, n, schema = [], [], [], 0, None
        for batch in batches:
            schema = batch.schema
            points = _scaled(batch.column("vector"), scale, parts)
            if held and points.size and points.shape[1] != held[0].shape[1]:
                raise ValueError("vectors of unlike lengths cannot share codebooks")
            most = max(block, group_values // max(points.shape[1], 1))
            own_ids, own_labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            lo = 0
            while lo < len(points):
                hi = min(len(points), lo + most - n)
                ids += own_ids[lo:hi]
                labels += own_labels[lo:hi]
                held.append(points[lo:hi])
                n += hi - lo
                lo = hi
                if n == most:
                    yield emit(ids, labels, np.concatenate(held), schema)
                    ids, labels, held, n = [], [], [], 0
        if n:
            yield emit(ids, labels, np.concatenate(held), schema)
    return build


def _groups(batch: pa.RecordBatch, parts: int, block: int):
    """The groups of a batch of packed rows: (row, their blocks by part)."""
    for k in range(batch.num_rows):
        row = {name: batch.column(name)[k].as_py() for name in
               ("n", "dims", "width", "flat", "perm", "low", "high", "sums")}
        n, dims = row["n"], row["dims"]
        kind = np.int16 if row["width"] == 2 else np.int64
        flat = np.frombuffer(row["flat"], kind).reshape(parts, n, dims)
        perm = np.frombuffer(row["perm"], np.int32).reshape(parts, n)
        low, high = (np.frombuffer(row[name], kind).reshape(parts, -(-n // block), dims)
                     for name in ("low", "high"))
        sums = np.frombuffer(row["sums"], np.int64).reshape(parts, -(-n // block), dims)
        yield k, [Blocks(flat[p].astype(np.int64), perm[p], low[p].astype(np.int64),
                         high[p].astype(np.int64), sums[p], block) for p in range(parts)]


def _round(books: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(books.shape[:2], np.int64)
        sums = np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, made in _groups(batch, len(books), block):
                for p, blocks in enumerate(made):
                    n, s = blocks.sums_by_entry(books[p])
                    counts[p] += n
                    sums[p] += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
             pa.array(counts[part, entry], pa.int64()),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])
    return run


def _encode(books: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, made in _groups(batch, len(books), block):
                found = [blocks.codes(book) for blocks, book in zip(made, books)]
                codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                text = codes.tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, batch.column("labels")[k].values,
                     pa.array([text[a:a + step] for a in range(0, len(text), step)], pa.string()),
                     pa.array(np.sum([dist for _, dist in found], axis=0), pa.int64())],
                    names=["vec_id", "label", "code", "error"])
    return run


class VectorCodes:
    """Codebooks and codes of a table of vectors.

    ``books``: parts x entries x components, on the driver. ``codes()``: vec_id,
    label, code, error, one row per kept vector.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
                 group_values: int = GROUP_VALUES):
        if not 1 <= entries <= 256:
            raise ValueError("entries must be 1 to 256: a code is one byte per part")
        self.block = block
        infinite = float("inf")
        bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double"))
                       | (F.abs(x) == F.lit(infinite)))
        kept = vectors.filter(F.col(vector_col).isNotNull() & ~bad).select(
            F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
            F.col(vector_col).alias("vector"))
        self.kinds = {name: kept.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
        packed = (f"ids array<{self.kinds['vec_id']}>, labels array<{self.kinds['label']}>, n int, "
                  "dims int, width int, flat binary, perm binary, low binary, high binary, sums binary")
        spark = vectors.sparkSession
        path = scratch_path(spark, "vector_groups")
        # a row holds about a megabyte: small row groups bound a reader's memory
        (kept.mapInArrow(_pack(scale, parts, block, group_values), packed).write
         .option("parquet.block.size", 32 << 20).option("parquet.block.size.row.check.min", 4)
         .option("parquet.page.size.row.check.min", 4).parquet(path))
        self.groups = spark.read.parquet(path)
        first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
        start = _scaled(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale, parts)
        self.books = start.reshape(len(first), parts, -1).transpose(1, 0, 2) if len(first) else None
        for _ in range(rounds if len(first) else 0):
            self.books = self._moved()

    def _moved(self) -> np.ndarray:
        """The next codebooks: floored means, exact sums over all tasks."""
        partial = self.groups.mapInArrow(_round(self.books, self.block),
                                         "part int, entry int, n bigint, sums array<bigint>")
        total = (partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
                 .groupBy("part", "entry", "at")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")))
        books = self.books.copy()
        for row in total.collect():  # parts x entries x components rows
            books[row["part"], row["entry"], row["at"]] = int(row["sum"]) // row["n"]
        return books

    def books_sha256(self) -> str:
        values = [] if self.books is None else self.books.ravel().tolist()
        return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()

    def codes(self) -> DataFrame:
        schema = f"vec_id {self.kinds['vec_id']}, label {self.kinds['label']}, code string, error bigint"
        if self.books is None:
            return self.groups.sparkSession.createDataFrame([], schema)
        return self.groups.mapInArrow(_encode(self.books, self.block), schema)


def compress_vectors(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls
    together), codebooks_sha256."""
    made = VectorCodes(vectors, **options)
    label = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n"))
    codes = written(made.codes().withColumn("key", label), "codes")
    totals = written(codes.groupBy("key").agg(F.sum("error").alias("label_error"),
                                              F.count(F.lit(1)).alias("n_rows")), "label_errors")
    return join_by_key(codes, totals, "key", "n_rows").select(
        "vec_id", "code", "error", "label_error",
        F.lit(made.books_sha256()).alias("codebooks_sha256"))
