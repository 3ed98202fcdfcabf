"""Operator 5: near-duplicate documents by SuperMinHash.

A document's set holds its distinct shingles (``shingle`` consecutive words of
the text with A-Z lower-cased; a shorter text gives its whole sequence of
words as one shingle). Two documents are linked if the Jaccard similarity of
their sets reaches ``percent`` / 100, checked on the full sets of words.

1. Sketch (one scan): SuperMinHash draws, per shingle, a random permutation
   step by step; slot p_j of the signature keeps the minimum of j + r_j. A
   document stops after the first step that cannot lower a slot any more, so
   long texts take one or two steps. The signature is cut into bands.
2. Documents with equal sets become one node, so copies cost one row each.
3. Banding: nodes that share a band form a bucket. Every member is checked
   against one pivot of its bucket, the member that shares most buckets with
   others, not against all members.
4. Union-find over the confirmed links. Buckets whose members now belong to
   one component are done. The others take a further round with other pivots,
   and more of them while rounds confirm links and the pairs that cross
   components are many; the crossing pairs left are then all checked in
   blocks, so no candidate is left out and no pairs are emitted.

With ``bands`` bands of ``rows`` values a pair of similarity s shares no band
with probability (1 - s^rows)^bands: 4e-7 at 0.8 with 28 x 4. Links confirmed
are exact.

Edge cases: a null or empty text has an empty set, is linked with nothing and
kept; rows equal in id and text are one document and get equal rows (and one of
them stays in ``keep_one_of_each``); ids are
ordered ascending with null last, ties by text digest; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, lean, row_key, whole_text, written, written_counted
from .components import extend_components

BANDS = 28
ROWS = 4
LANES = 4             # pivots per bucket in the rounds after the first
PAIRS_PER_MEMBER = 512  # crossing pairs per open bucket member that end the pivot rounds
BLOCK_SHINGLES = 40_000  # shingles of one block of an open cluster
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
_BLOCK = 1 << 15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_minhash(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """Signatures (sets x slots) of sets given as 64-bit ``elements`` with the
    number of their set; sets without elements keep infinity. Repeated
    elements change nothing."""
    sig = np.full(sets * slots, np.inf)
    perm = None
    for j in range(slots):
        if not len(elements):
            break
        draw = mix64(elements + np.uint64((j + 1) * int(_GOLD) % (1 << 64)))
        k = (j + (((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24))
             .astype(np.int64))
        rank = j + (draw >> np.uint64(24)).astype(np.float64) * 2.0 ** -40
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(elements))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, owner * slots + slot, rank)
        # a set goes on only while a later rank (> j) can lower one of its slots
        going = (sig.reshape(sets, slots) > j + 1).any(axis=1)[owner]
        if j == 0:
            perm = np.repeat(np.arange(slots, dtype=np.uint16)[None], int(going.sum()), axis=0)
            perm[np.arange(len(perm)), k[going]] = 0
        else:
            perm = perm[going]
        elements, owner = elements[going], owner[going]
    return sig.reshape(sets, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band."""
    bits = sig[:, :bands * rows].reshape(len(sig), bands, rows).view(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, bits.shape[:2])
    for r in range(rows):
        key = mix64((key ^ bits[:, :, r]) * _PRIME + np.uint64(r))
    return key.view(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray,
                   size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of documents given as word hashes, and their documents."""
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), n)
    first = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    length = np.minimum(counts, size)[owner]
    out = length.astype(np.uint64) * _GOLD
    words = words.view(np.uint64)
    for k in range(size):
        has = k < length
        out[has] = mix64(out[has] * _PRIME + words[first[has] + k])
    return out, owner


def _sketch(shingle: int, bands: int, rows: int):
    slots = bands * rows

    def one(words: np.ndarray, offsets: np.ndarray):
        found, owner = shingle_hashes(words, offsets, shingle)
        sets = len(offsets) - 1
        ends = np.searchsorted(owner, np.arange(sets + 1))
        sizes = np.zeros(sets, np.int64)
        marks = np.zeros((2, sets), np.uint64)
        for d in range(sets):
            distinct = np.unique(found[ends[d]:ends[d + 1]])
            sizes[d] = len(distinct)
            marks[0, d] = mix64(distinct).sum(dtype=np.uint64)
            marks[1, d] = mix64(distinct * _PRIME + _GOLD).sum(dtype=np.uint64)
        keys = band_keys(super_minhash(found, owner, sets, slots), bands, rows)
        return sizes, marks.view(np.int64), keys

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _BLOCK, "right")) - 1)
                at = offsets[lo:hi + 1]
                sizes, marks, keys = one(values[at[0]:at[-1]], at - at[0])
                has = sizes > 0
                ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_k"), part.column("doc_id"), pa.array(sizes, pa.int64()),
                     pa.array(marks[0]), pa.array(marks[1]),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.array(keys[has].reshape(-1)))],
                    names=["_k", "doc_id", "n_shingles", "f1", "f2", "bands"])
                lo = hi
    return sketch


def shingle_set(text: str, size: int) -> frozenset:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(size))))


def _confirm(shingle: int, percent: int):
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: OrderedDict = OrderedDict()
        held = 0

        def of(node: int, text: str) -> frozenset:
            nonlocal held
            if node not in kept:
                kept[node] = shingle_set(text, shingle)
                held += len(kept[node])
                while held > 60_000 and len(kept) > 2:
                    held -= len(kept.popitem(last=False)[1])
            kept.move_to_end(node)
            return kept[node]

        for frame in frames:
            ok = []
            for a, b, ta, tb in frame[["a", "b", "text_a", "text_b"]].itertuples(index=False):
                x, y = of(a, ta), of(b, tb)
                both = len(x & y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[np.array(ok, bool), ["a", "b"]]
    return check


def _links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    whole = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
             .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return whole.mapInPandas(_confirm(shingle, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """_k (row key), doc_id, n_shingles, component_id, first (the row, or an
    equal one, is the first of its component) and kept (doc_id is component_id)
    of every row."""
    words = F.filter(F.split(ascii_lower(whole_text(text_col)), r"[\x20\x09-\x0D]+"),
                     lambda w: w != F.lit(""))
    hashed = docs.select(row_key(id_col, text_col).alias("_k"), F.col(id_col).alias("doc_id"),
                         F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    kind = hashed.schema["doc_id"].dataType.simpleString()
    sketches = written(hashed.mapInArrow(
        lean(_sketch(shingle, bands, rows)), f"_k string, doc_id {kind}, n_shingles bigint, f1 bigint, "
        "f2 bigint, bands array<bigint>"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k")
    nodes = written(
        sketches.filter(F.col("n_shingles") > 0).groupBy("f1", "f2", "n_shingles")
        .agg(F.min(order).alias("rep"), F.first("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("id"), "f1", "f2", "n_shingles", "rep",
                "bands"), "nodes")
    roots = _components(docs, nodes, id_col, text_col, shingle, percent)
    # of each component the first row in order, by node
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select(
        "f1", "f2", "n_shingles", "rep", F.coalesce("root", "id").alias("root"))
    heads = named.groupBy("root").agg(F.min("rep").alias("head"))
    of_set = named.join(heads, "root").select("f1", "f2", "n_shingles", "head")
    return (sketches.join(of_set, ["f1", "f2", "n_shingles"], "left")
            .select("_k", "doc_id", "n_shingles",
                    F.when(F.col("head").isNull(), F.col("doc_id"))
                    .otherwise(F.col("head.doc_id")).alias("component_id"),
                    F.coalesce(F.col("head._k") == F.col("_k"), F.lit(True)).alias("first"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _pivots(rows: DataFrame, lanes: int, used: DataFrame | None) -> DataFrame:
    """b, p (weight, turn, id, root, n_shingles): per bucket and lane the member
    that shares most buckets with most others and was no pivot before. An
    original shares more with its edited copies than they do with each other."""
    sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    weights = rows.join(sizes, "b").groupBy("id").agg(F.sum("n").alias("weight"))
    if used is not None:
        weights = weights.join(used, "id", "left_anti")
    turn = F.xxhash64("id")
    return (rows.join(weights, "id").groupBy("b", F.pmod(turn, F.lit(lanes)).alias("lane"))
            .agg(F.max(F.struct("weight", turn.alias("t"), "id", "root", "n_shingles"))
                 .alias("p")).select("b", "p"))


def _components(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int,
                percent: int) -> DataFrame:
    """(node, root) of the nodes that are linked."""
    banded = nodes.select("id", "n_shingles", F.explode("bands").alias("b"))
    shared = (banded.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
              .filter(F.col("lo") < F.col("hi")).select("b"))
    members = written(banded.join(shared, "b"), "members")
    wanted = members.select("id").distinct().join(
        nodes.select("id", F.col("rep._k").alias("_k")), "id")
    texts = written(docs.select(row_key(id_col, text_col).alias("_k"),
                                whole_text(text_col).alias("text"))
                    .join(wanted, "_k").select("id", "text").dropDuplicates(["id"]), "texts")
    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    apart = members.withColumn("root", F.col("id"))
    roots = tested = used = None
    lanes = 1
    while True:
        # members against the pivots of their buckets that are of another component
        pivots = written(_pivots(apart, lanes, used), "pivots")
        fresh = (apart.join(pivots, "b")
                 .filter((F.col("root") != F.col("p.root"))
                         & near(F.col("n_shingles"), F.col("p.n_shingles")))
                 .select(F.greatest("id", F.col("p.id")).alias("a"),
                         F.least("id", F.col("p.id")).alias("b")).distinct())
        if tested is not None:
            fresh = fresh.join(tested, ["a", "b"], "left_anti")
        fresh = written(fresh, "pairs")
        found, grown = written_counted(_links(fresh, texts, shingle, percent), "near_links")
        tested = fresh if tested is None else tested.unionByName(fresh)
        now = pivots.select("p.id").distinct()
        used = now if used is None else written(used.unionByName(now).distinct(), "used")
        if grown or roots is None:
            roots = extend_components(roots, found)
        placed = members.select("b", "id", "n_shingles").join(
            roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
                "b", "id", "n_shingles", F.coalesce("root", "id").alias("root"))
        open_ = (placed.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                 .filter(F.col("lo") < F.col("hi")).select("b"))
        apart, n_apart = written_counted(placed.join(open_, "b"), "apart")
        if not n_apart:
            return roots
        # pairs of different components that share a bucket
        by_root = apart.groupBy("b", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
        crossing = by_root.groupBy("b").agg(
            ((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2).alias("p")
        ).agg(F.sum("p")).first()[0]
        if not grown or crossing <= PAIRS_PER_MEMBER * n_apart:
            break
        lanes = LANES
    return extend_components(roots, written(
        _open_links(apart, nodes, texts, shingle, percent), "near_links"))


def _check_blocks(shingle: int, percent: int):
    """Links between different components of a block, or of two blocks; pairs
    of components already linked here are skipped."""
    def check(frame: pd.DataFrame) -> pd.DataFrame:
        ids, roots = frame["id"].to_numpy(), frame["root"].to_numpy()
        sizes, blocks = frame["n_shingles"].to_numpy(), frame["blk"].to_numpy()
        bands = np.stack(frame["bands"].to_numpy())
        texts = frame["text"].to_numpy()
        sets: dict[int, frozenset] = {}
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        def of(k: int) -> frozenset:
            if k not in sets:
                sets[k] = shingle_set(texts[k], shingle)
            return sets[k]

        two = blocks.min() != blocks.max()
        found = []
        for i in np.nonzero(blocks == blocks.min())[0]:
            other = blocks != blocks[i] if two else np.arange(len(ids)) > i
            other &= roots != roots[i]
            other &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            js = np.nonzero(other)[0]
            for j in js[(bands[js] == bands[i]).any(axis=1)]:
                a, b = find(roots[i]), find(roots[j])
                if a == b:
                    continue
                x, y = of(i), of(j)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    up[a] = b
                    found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    return check


def _open_links(apart: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int,
                percent: int) -> DataFrame:
    """Links across components, from all pairs of members that share an open
    bucket. The buckets that share members are joined to clusters, so a pair
    is met once and not per band; a cluster is cut into blocks of a bounded
    number of shingles, and every pair of blocks is one group: members, not
    pairs, are emitted."""
    heads = apart.groupBy("b").agg(F.min("id").alias("head"))
    clusters = extend_components(None, apart.join(heads, "b").select(
        F.col("id").alias("a"), F.col("head").alias("b")))
    rows = (apart.select("id", "root", "n_shingles").distinct()
            .join(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), "id")
            .join(nodes.select("id", "bands"), "id").join(texts, "id"))
    parts = (apart.select("id", "n_shingles").distinct()
             .join(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), "id")
             .groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
                                     .cast("int").alias("parts")))
    dealt = (rows.join(parts, "cluster")
             .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumns({"lo": F.least("blk", "with"), "hi": F.greatest("blk", "with")}))
    return (dealt.select("cluster", "lo", "hi", "blk", "id", "root", "n_shingles", "bands", "text")
            .groupBy("cluster", "lo", "hi")
            .applyInPandas(_check_blocks(shingle, percent), "a bigint, b bigint"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     **options) -> DataFrame:
    """The documents that are the first of their component, all columns kept;
    of rows equal in id and text one stays."""
    found = written(near_duplicates(docs, id_col, text_col, **options).groupBy("_k").agg(
        F.first("first").alias("first"), F.count(F.lit(1)).alias("n")), "near_rows")
    key = row_key(id_col, text_col)
    # all but the keys that need nothing: others are few or none
    gone = found.filter(~F.col("first") | (F.col("n") > 1)).select(F.col("_k").alias("_key"))
    kept = docs.join(gone, key == F.col("_key"), "left_anti")
    repeated = found.filter(F.col("first") & (F.col("n") > 1)).select(F.col("_k").alias("_key"))
    if repeated.isEmpty():
        return kept
    once = docs.withColumn("_near_key", key).join(
        repeated, F.col("_near_key") == F.col("_key"), "left_semi").dropDuplicates(["_near_key"])
    return kept.unionByName(once.select(*docs.columns))
