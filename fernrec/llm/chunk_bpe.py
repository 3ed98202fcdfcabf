"""Operator 9: BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over the last 32 bytes cuts texts where its low bits are
zero, so equal passages give equal chunks wherever they stand. A cut usually
falls inside a word. The tokens of a chunk that hold in every text are those
of its core, from its first to its last ASCII white space (see ``tokens``: no
token crosses white space); the join of two chunks is repaired by re-encoding
the word the cut fell into, widened over further chunks until white space is
met on both sides, where it agrees exactly with both cores.

1. A scan hashes all cores (128 bits). Hashes seen twice or more are shared;
   the first place in document order owns each.
2. The documents, compressed for the exchange, meet the list of their shared
   cores. Joins and cores of their own are encoded there, and so is each
   shared core by its owner: once for all borrowers, and once more within the
   owner's own text.
3. Documents with borrowed cores join them by hash and are put together in
   order. All others are already done.

Edge cases: a null text is empty (no tokens, empty decoded text); repeated
rows give one result row each; rows with a null id are kept; a text without
white space is one join, encoded whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, whole_text, written
from .near_dedup import mix64
from .tokens import WORD_BPE, WordEncoder, encoder, text_slices, vocabulary_path

MEAN_BITS = 10          # a chunk has about 2^10 bytes
MIN_CHUNK = 256
MAX_CHUNK = 1 << 14
LEAST_CORE = 128        # shorter cores are cheaper to encode than to share

_GEAR = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At every byte, sum of gear[byte] << age over the last 32 bytes: doubling
    the window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunk_cuts(data: np.ndarray, bits: int = MEAN_BITS, least: int = MIN_CHUNK,
               most: int = MAX_CHUNK) -> list[int]:
    """Cuts inside the text; the size bounds hold from cut to cut."""
    n = len(data)
    marks = (np.nonzero(gear_hash(data) >> np.uint32(32 - bits) == 0)[0] + 1).tolist()
    cuts, last = [], 0
    for mark in marks:
        while mark - last > most:
            last += most
            cuts.append(last)
        if mark - last >= least and mark < n:
            cuts.append(mark)
            last = mark
    while n - last > most:
        last += most
        cuts.append(last)
    return cuts


def layout(text: bytes) -> list[tuple[int, int, bool]]:
    """Pieces (start, stop, is a core to share) of a text in order: cores
    between joins. Pieces start and end at white space or the text's ends."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < 2 * LEAST_CORE:
        return [(0, len(text), False)] if text else []
    cuts = np.array(chunk_cuts(data), np.int64)
    space = np.nonzero((data == 32) | ((data >= 9) & (data <= 13)))[0]
    at = np.searchsorted(space, cuts)
    # the word around a cut: from the last white space before it to the next
    left = np.where(at > 0, space[np.maximum(at - 1, 0)] if len(space) else -1, -1) + 1
    right = np.where(at < len(space), space[np.minimum(at, len(space) - 1)] if len(space) else 0,
                     len(data))
    pieces, done = [], 0
    for a, b in zip(left.tolist(), right.tolist()):
        if a > done:
            pieces.append((done, a, a - done >= LEAST_CORE))
            done = a
        if b > done:
            pieces.append((done, b, False))
            done = b
    if done < len(data):
        pieces.append((done, len(data), len(data) - done >= LEAST_CORE))
    return pieces


def _hash(core: bytes) -> tuple[int, int]:
    """128 bits of a core, as two signed longs."""
    digest = hashlib.blake2b(core, digest_size=16).digest()
    return (int.from_bytes(digest[:8], "little", signed=True),
            int.from_bytes(digest[8:], "little", signed=True))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, seqs, h1, h2 = [], [], [], []
        for first, texts in text_slices(batch.column("text")):
            for k, text in enumerate(texts, first):
                for seq, (a, b, core) in enumerate(layout(text)):
                    if core:
                        x, y = _hash(text[a:b])
                        row.append(k)
                        seqs.append(seq)
                        h1.append(x)
                        h2.append(y)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("t").take(at),
             pa.array(seqs, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
            names=["doc_id", "t", "seq", "h1", "h2"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack(x) for _, texts in text_slices(batch.column("text")) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("t"), pa.array(packed, pa.binary())],
            names=["doc_id", "t", "z"])


class _Digester:
    """Result columns of a text's ids."""

    def __init__(self, enc: WordEncoder, full: bool):
        self.tokenizer, self.full = enc.tokenizer, full
        self.names = None
        if self.tokenizer.decoder is None:  # the library then joins by blanks
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.names = [(self.tokenizer.id_to_token(k) or "").encode() for k in range(size)]

    def __call__(self, ids: np.ndarray) -> tuple:
        raw = ids.astype("<u4").tobytes()
        if self.names is not None:
            text = b" ".join(map(self.names.__getitem__, ids.tolist()))
        else:
            text = self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        out = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest())
        return out + ((raw, text.decode()) if self.full else (None, None))


_RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
_DONE, _SHARED, _OWN, _BORROWED = range(4)


def _result_arrays(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    return [pa.array(list(c), k) for c, k in zip(columns, kinds)]


def _encode(path: str, full: bool):
    """Done documents, shared cores and pieces of the documents that borrow."""
    def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[list]]]:
        unpack = zstandard.ZstdDecompressor().decompress
        first, texts, flags, size = 0, [], [], 0
        packed, shared = batch.column("z"), batch.column("shared").to_pylist()
        for k in range(batch.num_rows):
            texts.append(unpack(packed[k].as_py()))
            flags.append(shared[k] or [])
            size += len(texts[-1])
            if size >= 4 << 20:
                yield first, texts, flags
                first, texts, flags, size = k + 1, [], [], 0
        if texts:
            yield first, texts, flags

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        digest = _Digester(enc, full)
        width = enc.flat.dtype
        for batch in batches:
            for first, texts, flags in texts_of(batch):
                rows, kinds, seqs, hashes, results, pieces = [], [], [], [], [], []
                jobs: list[bytes] = []   # texts to encode, and what they are for
                uses: list[tuple] = []
                for k, (text, shared) in enumerate(zip(texts, flags), first):
                    if not shared:
                        jobs.append(text)
                        uses.append((k, _DONE, 0, None))
                        continue
                    marks = {s["seq"]: s for s in shared}
                    borrows = any(not s["own"] for s in shared)
                    start, spans = 0, layout(text)
                    for seq, (a, b, _) in enumerate(spans):
                        mark = marks.get(seq)
                        if mark is None:
                            continue
                        key = (mark["h1"], mark["h2"])
                        if mark["own"]:
                            jobs.append(text[a:b])
                            uses.append((k, _SHARED, seq, key))
                        if not mark["own"]:
                            if a > start:
                                jobs.append(text[start:a])
                                uses.append((k, _OWN, 2 * seq, None))
                            uses.append((k, _BORROWED, 2 * seq + 1, key))
                            jobs.append(b"")
                            start = b
                    if not borrows:
                        jobs.append(text)
                        uses.append((k, _DONE, 0, None))
                    elif start < len(text):
                        jobs.append(text[start:])
                        uses.append((k, _OWN, 2 * len(spans), None))
                found = enc.encode(jobs)
                ends = found.offsets
                for at, (k, kind, seq, key) in enumerate(uses):
                    ids = found.ids[ends[at]:ends[at + 1]]
                    rows.append(k)
                    kinds.append(kind)
                    seqs.append(seq)
                    hashes.append(key or (None, None))
                    results.append(digest(ids) if kind == _DONE else (None,) * 5)
                    pieces.append(ids.astype(width).tobytes() if kind in (_SHARED, _OWN) else None)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("t").take(take),
                     pa.array(kinds, pa.int32()), pa.array(seqs, pa.int32()),
                     pa.array([h[0] for h in hashes], pa.int64()),
                     pa.array([h[1] for h in hashes], pa.int64()),
                     pa.array(pieces, pa.binary()), *_result_arrays(results)],
                    names=["doc_id", "t", "kind", "seq", "h1", "h2", "piece", "n_tokens",
                           "ids_sha256", "decoded_sha256", "ids", "decoded"])
    return encode


def _assemble(path: str, full: bool):
    """Documents from their pieces, which arrive sorted by document and place;
    a document given twice has every place twice."""
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        digest = _Digester(enc, full)
        width = enc.flat.dtype
        key, parts, copies, last, kind = None, [], 0, None, None
        out: list = []

        def close() -> None:
            if key is not None:
                ids = np.frombuffer(b"".join(parts), width)
                out.extend([(key[0], digest(ids))] * copies)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in out], kind), *_result_arrays([r for _, r in out])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, t, seq, piece in zip(*(batch.column(c).to_pylist()
                                            for c in ("doc_id", "t", "seq", "piece"))):
                if (doc, t) != key:
                    close()
                    key, parts, copies, last, first = (doc, t), [piece], 1, seq, seq
                elif seq == last:
                    copies += seq == first
                else:
                    parts.append(piece)
                    last = seq
            if len(out) >= 1000:
                yield flush()
        close()
        if out:
            yield flush()
    return assemble


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     tokenizer: str | None = None, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``full``, ids
    (little-endian 32-bit, binary) and decoded (string) of every row."""
    path = tokenizer or vocabulary_path(WORD_BPE)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"),
                       whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cores = written(rows.mapInArrow(
        lean(_cores), f"doc_id {kind}, t bigint, seq int, h1 bigint, h2 bigint"), "cores")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "seq")
    shared = (cores.groupBy("h1", "h2").agg(F.min(place).alias("owner"), F.max(place).alias("last"))
              .filter(F.col("owner") != F.col("last")).select("h1", "h2", "owner"))
    flags = (cores.join(shared, ["h1", "h2"])
             .select("doc_id", "t", F.struct("seq", "h1", "h2", (place == F.col("owner"))
                                             .alias("own")).alias("s"))
             .groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
             .agg(F.collect_set("s").alias("shared")))
    packed = rows.mapInArrow(lean(_compress), f"doc_id {kind}, t bigint, z binary")
    met = (packed.join(flags, packed["doc_id"].eqNullSafe(flags["_id"])
                       & (packed["t"] == flags["_t"]), "left").select("doc_id", "t", "z", "shared"))
    encoded = written(met.mapInArrow(
        lean(_encode(path, full)), f"doc_id {kind}, t bigint, kind int, seq int, h1 bigint, h2 bigint, "
        f"piece binary, {_RESULT}"), "chunk_encoded")
    whole = encoded.filter(F.col("kind") == _DONE).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    cores_once = (encoded.filter(F.col("kind") == _SHARED).select("h1", "h2", "piece")
                  .dropDuplicates(["h1", "h2"]))
    borrowed = (encoded.filter(F.col("kind") == _BORROWED).select("doc_id", "t", "seq", "h1", "h2")
                .join(cores_once, ["h1", "h2"]).select("doc_id", "t", "seq", "piece"))
    own = encoded.filter(F.col("kind") == _OWN).select("doc_id", "t", "seq", "piece")
    ordered = (borrowed.unionByName(own).repartition("doc_id", "t")
               .sortWithinPartitions("doc_id", "t", "seq"))
    joined = ordered.mapInArrow(lean(_assemble(path, full)), f"doc_id {kind}, {_RESULT}")
    out = whole.unionByName(joined)
    return out if full else out.drop("ids", "decoded")
