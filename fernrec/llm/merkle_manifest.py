"""Operator 13: Merkle dataset manifest as a postorder append log.

Every source is a tree over its documents in id order, ``FAN`` nodes to a
parent; the sources' roots are the leaves of a top tree of the same form. The
log of a tree lists its nodes in the order they are completed (postorder). Where
a node stands follows from the sizes of the complete subtrees before it:

  leaf j       j + j div 16 + j div 16^2 + ...     (parents completed before it)
  node (l, i)  place of its last leaf, + l

Builders are aligned: a task takes ``FAN ** LEVELS`` consecutive nodes of one
level, whose parents depend on no other task, appends them and all their
parents up to ``LEVELS`` levels in completion order, and hands its last node
on. The handed nodes are built the same way, until one is left per tree, so no
tree, whatever its size, meets in one task. A builder's piece of the log
is one row (a segment); ``log_nodes`` gives every node its place in the whole.

Proofs go down again: a segment gets the path from its last node to the root
and hands every one of its first nodes the siblings found at their closed-form
places, before that path. The last step does so for documents: it hashes the
siblings and recomputes the root from the (possibly changed) leaf and them.

Edge cases: null fields are ``-``; null ids come first, the null source is
the first source; rows with equal ids are ordered by leaf, equal rows are
leaves of their own; one leaf is its tree's root and has no siblings there (its
proof hashes what the top tree adds, or the empty text); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, crc_mod, running, written

FAN = 16
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MOD = 5
_TOP = "top"


def hash_nodes(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def log_place(level: int, index: int, leaves: int) -> int:
    """Place of node (level, index) in the log of a tree of ``leaves``."""
    last = min((index + 1) * FAN ** level, leaves) - 1
    place, part = last + level, last // FAN
    while part:
        place, part = place + part, part // FAN
    return place


def append_log(leaves: list[str], levels: int) -> list[str]:
    """The log of ``leaves`` (consecutive, aligned) and ``levels`` levels of
    parents, in completion order."""
    log: list[str] = []
    open_nodes: list[list[str]] = [[] for _ in range(levels + 1)]

    def append(node: str, level: int) -> None:
        log.append(node)
        open_nodes[level].append(node)
        if level < levels and len(open_nodes[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        nodes, open_nodes[level] = open_nodes[level], []
        append(hash_nodes(nodes), level + 1)

    for leaf in leaves:
        append(leaf, 0)
    for level in range(levels):  # the last run of a level may have fewer
        if open_nodes[level]:
            close(level)
    return log


def siblings(log: list[str], n: int, levels: int, index: int) -> list[tuple[int, list[str]]]:
    """Per level the place of leaf ``index``'s ancestor in its run, and the
    run's other nodes, addressed in the log of ``n`` leaves."""
    out = []
    for level in range(levels):
        count = -(-n // FAN ** level)
        first = index // FAN * FAN
        run = [log[log_place(level, k, n)] for k in range(first, min(first + FAN, count))]
        at = index - first
        out.append((at, run[:at] + run[at + 1:]))
        index //= FAN
    return out


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root from a leaf and its siblings, level by level."""
    for at, others in path:
        node = hash_nodes([*others[:at], node, *others[at:]])
    return node


def _pack_path(path: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes([at, len(others)]) + bytes.fromhex("".join(others)) for at, others in path)


def _unpack_path(data: bytes) -> list[tuple[int, list[str]]]:
    path, k = [], 0
    while k < len(data):
        at, n = data[k], data[k + 1]
        raw = data[k + 2:k + 2 + 32 * n].hex()
        path.append((at, [raw[64 * j:64 * j + 64] for j in range(n)]))
        k += 2 + 32 * n
    return path


def _split(data: bytes) -> list[str]:
    text = data.hex()
    return [text[k:k + 64] for k in range(0, len(text), 64)]


_SEGMENT = ("tree string, chunk bigint, n int, levels int, n_up bigint, digest string, log binary, "
            "keys array<string>, ids array<string>, changed array<string>")


def _builder(levels: int):
    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        total = int(frame["total"].iloc[0])
        up = min(levels, height(total))
        log = append_log(frame["digest"].tolist(), up)
        n_up = -(-total // FAN ** up)
        row = {"tree": key[0], "chunk": key[1], "n": len(frame), "levels": up, "n_up": n_up,
               "digest": log[-1], "log": bytes.fromhex("".join(log))}
        for many, one in (("keys", "key"), ("ids", "id"), ("changed", "change")):
            values = frame[one]
            row[many] = (None if values.isna().all() and one != "id" else
                         values.astype(object).where(values.notna(), None).tolist())
        return pd.DataFrame([row])
    return build


def _build(nodes: DataFrame, n_max: int, levels: int) -> list[DataFrame]:
    """The segments of every round, from the leaves up. ``nodes``: tree, idx,
    total (nodes of the tree's level), digest, key, id, change."""
    rounds = []
    while True:
        chunk = F.floor(F.col("idx") / F.lit(FAN ** levels)).alias("chunk")
        made = (nodes.groupBy("tree", chunk)
                .applyInPandas(_builder(levels), _SEGMENT))
        made = written(made, "segments")
        rounds.append(made)
        n_max = -(-n_max // FAN ** levels)
        if n_max <= 1:
            return rounds
        nothing = F.lit(None).cast("string")
        nodes = made.filter(F.col("n_up") > 1).select(
            "tree", F.col("chunk").alias("idx"), F.col("n_up").alias("total"), "digest",
            nothing.alias("key"), nothing.alias("id"), nothing.alias("change"))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """tree, digest, round: every tree's last node and the round that made it."""
    parts = [made.filter(F.col("n_up") == 1).select("tree", "digest", F.lit(k).alias("round"))
             for k, made in enumerate(rounds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The paths of a segment's first nodes, from the segment's own path."""
    for frame in batches:
        for row in frame.itertuples(index=False):
            log, above = _split(row.log), bytes(row.path)
            first = row.chunk * FAN ** row.full_levels
            own = [siblings(log, row.n, row.levels, k) for k in range(row.n)]
            yield pd.DataFrame({
                "tree": row.tree, "chunk": [first + k for k in range(row.n)],
                "key": list(row.keys) if row.keys is not None else [None] * row.n,
                "path": [_pack_path(p) + above for p in own],
                "node": [log[log_place(0, k, row.n)] for k in range(row.n)],
                "subroot": row.subroot, "root": row.root})


def _paths(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """tree, chunk, path, subroot, root of the first round's segments. ``top``:
    tree, round, path (of the tree's root), subroot, root."""
    found = None
    for k in reversed(range(len(rounds))):
        starts = top.filter(F.col("round") == k).select(
            "tree", F.lit(0).cast("bigint").alias("chunk"), "path", "subroot", "root")
        found = starts if found is None else starts.unionByName(found)
        if k:
            found = written(rounds[k].join(found, ["tree", "chunk"]).select(
                "tree", "chunk", "n", "levels", "log", "keys", "path", "subroot", "root",
                F.lit(levels).alias("full_levels"))
                .mapInPandas(_hand_down, "tree string, chunk bigint, key string, path binary, "
                             "node string, subroot string, root string"), "paths")
            found = found.select("tree", "chunk", "path", "subroot", "root")
    return found


def _prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for row in frame.itertuples(index=False):
            log, above = _split(row.log), _unpack_path(bytes(row.path))
            above_text = "".join("".join(others) for _, others in above)
            changed = row.changed if row.changed is not None else [None] * row.n
            leaves, proofs, folded = [], [], []
            for k in range(row.n):
                own = siblings(log, row.n, row.levels, k)
                leaf = log[log_place(0, k, row.n)]
                text = "".join("".join(others) for _, others in own) + above_text
                leaves.append(leaf)
                proofs.append(hashlib.sha256(text.encode()).hexdigest())
                folded.append(fold(changed[k] or leaf, own + above))
            yield pd.DataFrame({
                "doc_id": pd.Series(list(row.ids), dtype=object), "leaf": leaves,
                "subroot": row.subroot, "root": row.root, "proof_sha256": proofs,
                "folded_root": folded, "verified": [f == row.root for f in folded]})


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields: ``-`` for null, else byte count, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t),
                                        F.lit("-")) for t in texts]), 256)


class Manifest:
    """The built log and the trees' roots; ``docs`` needs the columns FIELDS.

    segments  per round (leaves up), tree (``s`` + source, empty for null),
              chunk, n, levels, log
    top       the same of the tree over the sources
    subroots  tree, digest, round
    """

    def __init__(self, docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS):
        """``tampered``: a text to check against the log in place of the row's
        own; null leaves the row as it is."""
        self.levels = levels
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        leaf = leaf_digest([F.col(c) for c in FIELDS])
        change = nothing = F.lit(None).cast("string")
        if tampered is not None:
            change = F.when(tampered.isNotNull(), leaf_digest(
                [tampered if c == "text" else F.col(c) for c in FIELDS]))
        tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("s"), F.col("source").cast("string")))
        rows = written(docs.select(tree.alias("tree"), F.col("doc_id").alias("id"),
                                   leaf.alias("digest"), change.alias("change")), "leaves")
        rows = running(rows, "tree", ["id", "digest"], {"n": F.lit(1)})
        nodes = rows.select("tree", F.col("before_n").alias("idx"), F.col("all_n").alias("total"),
                            "digest", nothing.alias("key"), F.col("id").cast("string").alias("id"), "change")
        sizes = rows.groupBy("tree").agg(F.max("all_n").alias("n"))
        n_max, n_trees = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
        self.segments = _build(nodes, int(n_max or 0), levels)
        self.subroots = written(_roots(self.segments), "subroots")
        ranked = running(self.subroots.withColumn("_one", F.lit("")), "_one", ["tree"],
                         {"n": F.lit(1)})
        self.top = _build(ranked.select(
            F.lit(_TOP).alias("tree"), F.col("before_n").alias("idx"), F.col("all_n").alias("total"),
            "digest", F.col("tree").alias("key"), nothing.alias("id"), nothing.alias("change")),
            int(n_trees), levels)

    def root(self) -> str | None:
        row = _roots(self.top).first()
        return row["digest"] if row else None

    def log_nodes(self) -> DataFrame:
        """tree, place, digest: the trees' logs (ordered by place: the files an
        append log would hold). A handed node is listed by its builder only."""
        parts = []
        for k, made in enumerate(self.segments):
            parts.append(made.select("tree", "chunk", "n", "levels", "log",
                                     F.lit(k).alias("round"), F.lit(self.levels).alias("full_levels")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        sizes = self.segments[0].groupBy("tree").agg(F.sum("n").alias("leaves"))
        return out.join(sizes, "tree").mapInPandas(_placed, "tree string, place bigint, digest string")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
        start = _roots(self.top).select("tree", "round", F.lit(b"").alias("path"),
                                        F.lit("").alias("subroot"), F.col("digest").alias("root"))
        top = _paths(self.top, start, self.levels)
        paths = self.top[0].join(top, ["tree", "chunk"]).select(
            "tree", "chunk", "n", "levels", "log", "keys", "path", "subroot", "root",
            F.lit(self.levels).alias("full_levels")).mapInPandas(
            _hand_down, "tree string, chunk bigint, key string, path binary, node string, "
            "subroot string, root string")
        paths = written(paths.select(F.col("key").alias("tree"), "path", F.col("node").alias("subroot"),
                                     "root"), "top_paths")
        top_paths = paths.join(self.subroots.select("tree", "round"), "tree")
        found = _paths(self.segments, top_paths, self.levels)
        return (self.segments[0].join(found, ["tree", "chunk"])
                .select("n", "levels", "log", "ids", "changed", "path", "subroot", "root")
                .mapInPandas(_prove, "doc_id string, leaf string, subroot string, root string, "
                             "proof_sha256 string, folded_root string, verified boolean")
                .withColumn("doc_id", F.col("doc_id").cast(self.kind)))


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for row in frame.itertuples(index=False):
            log = _split(row.log)
            places, digests = [], []
            below = row.round * row.full_levels
            first = row.chunk * FAN ** row.full_levels
            for level in range(row.levels + 1):
                if level == 0 and row.round:
                    continue
                for k in range(-(-row.n // FAN ** level)):
                    places.append(log_place(below + level, first // FAN ** level + k, row.leaves))
                    digests.append(log[log_place(level, k, row.n)])
            yield pd.DataFrame({"tree": row.tree, "place": places, "digest": digests})


def tampered_text(mod: int = TAMPER_MOD) -> Column:
    """The lower-cased text where ``mod`` divides the crc32 of the id, else null."""
    return F.when(crc_mod(F.col("doc_id"), mod) == 0, ascii_lower(F.col("text")))


def merkle_proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Build the manifest of ``docs`` and check every row, tampered or not."""
    return Manifest(docs, tampered_text(), levels).proofs()
