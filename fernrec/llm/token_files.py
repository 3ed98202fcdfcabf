"""Operator 2: token-id shards stored as wavelet matrices.

Documents are range-partitioned by id and sorted, each task encodes its
documents, appends the end id to each, and cuts the id stream at document
boundaries into shards of about ``shard_tokens`` ids (a longer document gets a
shard of its own). A shard is one compressed binary file held in one row of a
Parquet table, so that every store Spark writes to can hold it.

File format (little-endian); planes and docs are each one zstd frame behind its
length (u64):
  header  magic ``WVM1``, planes (u32), ids (u64), documents (u64)
  zeros   planes x u64: zero bits of each plane
  planes  from the highest bit to the lowest: ids / 8 bytes of bits in the
          order of that level, then one u32 per 512 bits (ones before it)
  docs    documents x u64: ids of each document

A level's order is the previous one stably partitioned by its bit, zeros
first. ``WaveletMatrix`` answers ``access`` (the id at a place), ``rank`` (how
often an id occurs before a place) and ``select`` (the place of the k-th
occurrence) from the planes alone, without expanding the ids.

Edge cases: a null text is empty and gives just the end id; null ids sort
first; repeated rows are kept, each a document of its own; rows with equal ids
are ordered by a hash of the text; other columns are ignored; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_partitions, scratch_path
from .common import whole_text
from .tokens import WORD_BPE, encoder, text_slices, vocabulary_path

END_ID = 2
SHARD_TOKENS = 1 << 17
RANK_BITS = 512
_MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sIQQ")


def _pack(part: bytes) -> bytes:
    small = zstandard.ZstdCompressor(level=1).compress(part)
    return struct.pack("<Q", len(small)) + small


def build_file(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The shard file of ``ids`` (uint32), documents of ``counts`` ids each."""
    planes = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    zeros = np.zeros(planes, "<u8")
    parts = []
    level = ids.astype("<u2" if planes <= 16 else "<u4")
    for k in range(planes):
        # the byte that holds the bit
        byte, shift = divmod(planes - 1 - k, 8)
        is_one = (level.view(np.uint8)[byte::level.itemsize] >> shift & 1).view(bool)
        packed = np.packbits(is_one, bitorder="little")
        sums = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(
            0, len(packed), RANK_BITS // 8)) if len(packed) else np.zeros(0, np.int64)
        ranks = (np.cumsum(sums) - sums).astype("<u4")
        parts.append(_pack(packed.tobytes() + ranks.tobytes()))
        zeros[k] = len(is_one) - int(sums.sum())
        level = np.concatenate([level[~is_one], level[is_one]])
    return b"".join([_HEAD.pack(_MAGIC, planes, len(ids), len(counts)), zeros.tobytes(), *parts,
                     _pack(counts.astype("<u8").tobytes())])


class WaveletMatrix:
    """A shard file: succinct access, counting and occurrence lookup."""

    def __init__(self, data: bytes):
        magic, self.planes, self.n, self.docs = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size
        self.zeros = np.frombuffer(data, "<u8", self.planes, at).astype(np.int64)
        at += 8 * self.planes
        self.bits, self.ranks = [], []
        for _ in range(self.planes):
            part, at = self._unpack(data, at)
            self.bits.append(np.frombuffer(part, np.uint8, (self.n + 7) // 8))
            self.ranks.append(np.frombuffer(part, "<u4", offset=(self.n + 7) // 8))
        part, at = self._unpack(data, at)
        self.counts = np.frombuffer(part, "<u8").astype(np.int64)

    @staticmethod
    def _unpack(data: bytes, at: int) -> tuple[bytes, int]:
        (size,) = struct.unpack_from("<Q", data, at)
        return zstandard.decompress(data[at + 8:at + 8 + size]), at + 8 + size

    def _ones(self, k: int, place: int) -> int:
        """Ones of plane k before ``place``."""
        if place >= self.n:
            return self.n - int(self.zeros[k])
        block = place // RANK_BITS
        raw = np.unpackbits(self.bits[k][block * RANK_BITS // 8:place // 8 + 1],
                            bitorder="little")[:place - block * RANK_BITS]
        return int(self.ranks[k][block]) + int(raw.sum())

    def _bit(self, k: int, place: int) -> int:
        return int(self.bits[k][place >> 3] >> (place & 7)) & 1

    def access(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for k in range(self.planes):
            ones = self._ones(k, place)
            if self._bit(k, place):
                value, place = value * 2 + 1, int(self.zeros[k]) + ones
            else:
                value, place = value * 2, place - ones
        return value

    def _range(self, value: int, place: int) -> tuple[int, int]:
        """The last level's range that holds the ``value``s before ``place``."""
        lo, hi = 0, min(max(place, 0), self.n)
        for k in range(self.planes):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if value >> (self.planes - 1 - k) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, place: int) -> int:
        """Occurrences of ``value`` before ``place``."""
        if value >> self.planes:
            return 0
        lo, hi = self._range(value, place)
        return hi - lo

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) ``bit`` of plane k."""
        ranks = self.ranks[k].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * RANK_BITS - ranks
        block = int(np.searchsorted(before, nth, "right")) - 1
        raw = np.unpackbits(self.bits[k][block * RANK_BITS // 8:(block + 1) * RANK_BITS // 8],
                            bitorder="little")[:self.n - block * RANK_BITS]
        return block * RANK_BITS + int(np.nonzero(raw == bit)[0][nth - int(before[block])])

    def select(self, value: int, nth: int) -> int:
        """The place of the nth (from 0) occurrence of ``value``."""
        if value >> self.planes:
            raise IndexError(nth)
        lo, hi = self._range(value, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        place = lo + nth
        for k in reversed(range(self.planes)):
            if value >> (self.planes - 1 - k) & 1:
                place = self._select_bit(k, 1, place - int(self.zeros[k]))
            else:
                place = self._select_bit(k, 0, place)
        return place

    def ids(self) -> np.ndarray:
        """All ids in order: the levels undone from the last to the first."""
        value = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for k in reversed(range(self.planes)):
            ones = np.unpackbits(self.bits[k], count=self.n, bitorder="little").astype(bool)
            zeros = int(self.zeros[k])
            level = np.empty_like(value)
            level[~ones] = value[:zeros]
            level[ones] = value[zeros:] | value.dtype.type(1 << (self.planes - 1 - k))
            value = level
        return value.astype(np.uint32)


def _shards(path: str, end_id: int, shard_tokens: int):
    def emit(held: list, before: int, kind: pa.DataType) -> pa.RecordBatch:
        part, seq = held[0][0], held[0][1]
        doc_ids = [d for h in held for d in h[2]]
        counts = np.concatenate([h[3] for h in held])
        ids = np.concatenate([h[4] for h in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int64()),
             pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(kind)),
             pa.array([len(ids)], pa.int64()),
             pa.array([build_file(ids, counts)], pa.binary())],
            names=["part", "seq", "before", "doc_ids", "n_ids", "file"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        held: list = []
        size = seq = done = 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            keys = batch.column("doc_id").to_pylist()
            part = batch.column("part")[0].as_py() if len(keys) else 0
            for lo, texts in text_slices(batch.column("text")):
                found = enc.encode(texts)
                counts = found.counts + 1
                ids = np.insert(found.ids, found.offsets[1:], np.uint32(end_id))
                ends = np.cumsum(counts)
                # cut before the document that would pass the shard size
                a = 0
                while a < len(counts):
                    base = int(ends[a] - counts[a])
                    b = int(np.searchsorted(ends, base + shard_tokens - size, "right"))
                    if b <= a and size:
                        yield emit(held, done, kind)
                        held, size, seq, done = [], 0, seq + 1, done + size
                        continue
                    b = max(b, a + 1)
                    held.append((part, seq, keys[lo + a:lo + b], counts[a:b],
                                 ids[base:int(ends[b - 1])]))
                    size += int(ends[b - 1]) - base
                    a = b
        if held:
            yield emit(held, done, kind)
    return build


def write_token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", tokenizer: str | None = None,
                      end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
                      partitions: int | None = None) -> str:
    """Write the shards as a Parquet table: part and seq (their order), before
    (ids of the part before the shard), doc_ids, n_ids, file. Returns its path."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token_files")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # equal ids are told apart by text, equal rows by their place in the input,
    # so no id holds one task
    order = ["doc_id", "_digest", "_tie"]
    ranged = (rows.withColumn("_digest", F.xxhash64("text"))
              .withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(partitions or default_partitions(spark), *order)
              .sortWithinPartitions(*order)
              .select(F.spark_partition_id().alias("part"), "doc_id", "text"))
    (ranged.mapInArrow(_shards(tokenizer or vocabulary_path(WORD_BPE), end_id, shard_tokens),
                       f"part int, seq bigint, before bigint, doc_ids array<{kind}>, n_ids bigint, "
                       "file binary")
     .write.option("parquet.block.size", 32 << 20).option("compression", "uncompressed")
     .parquet(path))
    return path


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("file")
        kind = batch.schema.field("doc_ids").type.value_type
        for k in range(batch.num_rows):
            matrix = WaveletMatrix(files[k].as_py())
            raw = matrix.ids().astype("<u4").tobytes()
            ends = np.cumsum(matrix.counts)
            starts = ends - matrix.counts
            crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids")[k].values.cast(kind),
                 pa.array(starts + batch.column("before")[k].as_py(), pa.int64()),
                 pa.array(matrix.counts, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_digests(docs_files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a shard table."""
    kind = docs_files.schema["doc_ids"].dataType.elementType.simpleString()
    # one row per range partition, whose number the writer fixed
    by_part = docs_files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before_part = by_part.select("part", F.coalesce(F.sum("_n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before_part"))
    return (docs_files.join(F.broadcast(before_part), "part")
            .select("doc_ids", "file", (F.col("before") + F.col("_before_part")).alias("before"))
            .mapInArrow(_read_docs, f"doc_id {kind}, start bigint, n_tokens bigint, "
                        "ids_crc32 bigint"))


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Write the shards of ``docs`` and read their digests back."""
    return read_token_digests(docs.sparkSession.read.parquet(write_token_files(docs, **options)))
