"""Coordinate half-steps of element-wise ALS.

One half-step updates every vector of one side (users or items) given the
other side's vectors and the K x K Gram matrix ``S`` of the other side. For
entity ``e`` with history rows ``(o, c)`` (``c`` = the item weight of the
row), for ``f = 0..K-1`` in order, using already updated coordinates::

    r^f_o = rhat_o - x_f y_of
    x_f  <- [ sum_o (w r - (w - c) r^f_o) y_of - m sum_{k!=f} x_k S_kf ]
            / [ sum_o (w - c) y_of^2 + m S_ff + lambda ]

with ``m = 1`` for users and ``m = c_e`` for items. Entities without history
keep their vector.

Distribution (no matrix on the driver, no per-key arrays):

* **Light entities** are packed into blocks of at most ``rows_per_block`` rows
  and one entity (``operators.packing``), dealt evenly to the tasks. The vectors of the other side
  that a block needs are routed to it once per block (``routing`` join), so
  an item vector travels once per block, not once per interaction. One
  Arrow-batched task per block runs the sweep vectorized over all entities
  of the block (``bincount`` segment sums, one pass per coordinate).
* **Heavy entities** (more rows than ``heavy_threshold``, e.g. an item held
  by a third of all users) never sit in one task. An entity of n rows is split
  by a hash of the other side's id into about n / ``heavy_chunk_rows`` cells
  (a power of two); a part holds the same cell of a few entities with as many
  splits, so they share the vectors routed to it. A cell emits one row with the
  partial sums ``A = sum (w-c) y y^T`` (upper triangle) and ``b = w r sum y``;
  so partial rows follow rows / ``heavy_chunk_rows``, however many entities
  there are. One small task per heavy entity adds them up and solves the same
  sweep in Gram form ``x_f <- (b_f - sum_{k!=f} T_fk x_k) / (T_ff + lambda)``,
  ``T = A + m S`` (exact algebra, same fixed point as the direct form).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, materialize_bucketed, release
from .factors import vec_type
from .packing import Packing, pack
from .prepare import rank_rows

_CHUNK = 1 << 16  # rows per vectorized dot-product chunk inside a task
_ADD_AT_ONCE = 64  # partial sums of an entity added by one task without a level between
_MAX_PARTS = 1 << 15  # files of the bucketed heavy rows; parts beyond share buckets
_CELL_BITS = 24  # splits of one entity at most


@dataclass
class SideLayout:
    """Static, per-training routing of one side's history (built once)."""

    side: str            # "user" or "item"
    blocks: int
    light: DataFrame     # blk, e, o, c  (+ marker rows o = -1 for heavy entities),
                         # bucketed by blk: read without a shuffle every half-step
    packing: Packing     # the block of every entity
    routing: DataFrame   # blk, o
    heavy: DataFrame | None    # part, e, o, c, bucketed by part
    heavy_routing: DataFrame | None  # part, o
    heavy_groups: int    # partial sums of an entity are added in so many groups first
    heavy_keys: DataFrame | None  # e, m
    heavy_entities: int
    light_rows: int


def build_layout(hist: DataFrame, side: str, heavy_threshold: int,
                 rows_per_block: int, num_blocks: int | None = None,
                 heavy_chunk_rows: int | None = None,
                 num_entities: int | None = None) -> SideLayout:
    """Route ``hist`` (user_idx, item_idx, c; a written table, as ``prepare``
    returns it) for updates of ``side``, whose indices run to ``num_entities - 1``
    (by default to the largest with a row)."""
    if side not in ("user", "item"):
        raise ValueError("side must be 'user' or 'item'")
    e_col, o_col = ("user_idx", "item_idx") if side == "user" else ("item_idx", "user_idx")
    spark = hist.sparkSession
    # ``hist`` is a written table: a renamed projection of it is stable
    rows = hist.select(F.col(e_col).alias("e"), F.col(o_col).alias("o"), "c")
    nnz = rows.count()
    cores = spark.sparkContext.defaultParallelism
    deg = rows.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("m"))
    deg, _ = materialize(deg, f"{side}_degrees")
    is_heavy = F.col("n") > F.lit(heavy_threshold)
    heavy_keys, n_heavy = materialize(deg.filter(is_heavy), f"{side}_heavy_keys", count=True)
    if num_entities is None:
        num_entities = int(deg.agg(F.max("e")).first()[0] or 0) + 1

    light, heavy, heavy_routing, groups, n_rows = rows, None, None, 1, 0
    if n_heavy:
        markers = heavy_keys.select("e", F.lit(-1).cast("bigint").alias("o"),
                                    F.lit(0.0).alias("c"))
        light = rows.join(heavy_keys.select("e"), "e", "left_anti").unionByName(markers)
        n_rows, most = heavy_keys.agg(F.sum("n"), F.max("n")).first()
        chunk = heavy_chunk_rows or heavy_threshold
        cells = heavy_cells(heavy_keys, chunk, max(1, rows_per_block // chunk))
        cell = F.pmod(F.xxhash64("o"), F.col("splits"))
        heavy = rows.join(cells, "e").select(
            F.col("base").bitwiseOR(cell).alias("part"), "e", "o", "c")
        parts = min(max(cores, math.ceil(n_rows / chunk)), _MAX_PARTS)
        heavy, _ = materialize_bucketed(heavy, f"{side}_heavy", "part", parts)
        heavy_routing, _ = materialize(heavy.select("part", "o").distinct(), f"{side}_heavy_routing")
        splits = 1 << max(0, math.ceil(most / chunk) - 1).bit_length()
        groups = math.isqrt(splits) if splits > _ADD_AT_ONCE else 1

    # at least one block per core; more when a block would exceed rows_per_block
    total = nnz - n_rows + num_entities
    size = math.ceil(total / (num_blocks or cores))
    packing = pack(deg.filter(~is_heavy), num_entities,
                   max(1, size if num_blocks else min(size, rows_per_block)))
    light, n_light = materialize_bucketed(packing.with_block(light, "e").select("blk", "e", "o", "c"),
                                          f"{side}_light", "blk", packing.buckets)
    routing, _ = materialize(
        light.filter(F.col("o") >= 0).select("blk", "o").distinct(), f"{side}_routing")
    release(deg)
    return SideLayout(side, packing.blocks, light, packing, routing, heavy, heavy_routing, groups,
                      heavy_keys, n_heavy, n_light)


def heavy_cells(heavy_keys: DataFrame, chunk: int, together: int) -> DataFrame:
    """``e, splits, base``: an entity of n rows has the power of two from n /
    ``chunk`` up as splits; ``base + cell`` numbers its parts, which it shares
    with up to ``together - 1`` entities of as many splits."""
    doubled = F.ceil(F.log2(F.ceil(F.col("n") / F.lit(chunk)).cast("double")))
    splits = F.pow(F.lit(2.0), doubled).cast("bigint")
    ranked = rank_rows(heavy_keys.select("e", splits.alias("splits")), ["splits", "e"], "r")
    return ranked.select("e", "splits", (F.floor(F.col("r") / F.lit(together))
                                         * F.lit(1 << _CELL_BITS)).alias("base"))


def release_layout(layout: SideLayout) -> None:
    """Delete the scratch tables of a layout once training is done."""
    for df in (layout.light, layout.routing, layout.heavy, layout.heavy_routing, layout.heavy_keys,
               layout.packing.ranges):
        release(df)


def _vec_frame(ids: np.ndarray, mat: np.ndarray) -> pd.DataFrame:
    """``idx, vec`` frame; an object column even when empty (Arrow list type)."""
    vec = pd.Series(list(mat), dtype=object) if len(ids) else pd.Series([], dtype=object)
    return pd.DataFrame({"idx": np.asarray(ids, dtype=np.int64), "vec": vec})


def _block_kernel(side: str, s: np.ndarray, lam: float, w: float, r: float, dtype: str):
    k = s.shape[0]
    out_dtype = np.float32 if dtype == "float32" else np.float64
    s_diag = np.diag(s).copy()

    def run(rows: pd.DataFrame, vecs: pd.DataFrame) -> pd.DataFrame:
        """``rows``: blk, e, o, c (static); ``vecs``: blk, kind, id, vec with
        kind 0 = vectors being updated, kind 1 = routed vectors of the other side."""
        is_ent = vecs["kind"].to_numpy() == 0
        ents = vecs[is_ent]
        others = vecs[~is_ent]
        if len(ents) == 0:
            return _vec_frame(np.zeros(0), np.zeros((0, k)))
        order = np.argsort(ents["id"].to_numpy(), kind="stable")
        e_ids = ents["id"].to_numpy()[order]
        x = np.vstack(ents["vec"].to_numpy()[order]).astype(np.float64)
        skip = np.zeros(len(e_ids), dtype=bool)

        markers = rows["o"].to_numpy() < 0
        if markers.any():
            skip[np.searchsorted(e_ids, rows["e"].to_numpy()[markers])] = True
            rows = rows[~markers]

        if len(rows) and len(others):
            o_order = np.argsort(others["id"].to_numpy(), kind="stable")
            o_ids = others["id"].to_numpy()[o_order]
            y = np.vstack(others["vec"].to_numpy()[o_order]).astype(np.float64)
            u = np.searchsorted(e_ids, rows["e"].to_numpy())
            o = np.searchsorted(o_ids, rows["o"].to_numpy())
            c = rows["c"].to_numpy(dtype=np.float64)
            n_e = len(e_ids)
            has = np.bincount(u, minlength=n_e) > 0
            mult = np.ones(n_e)
            if side == "item":
                mult[u] = c
            wmc = w - c
            rhat = np.empty(len(u))
            for lo in range(0, len(u), _CHUNK):
                hi = min(lo + _CHUNK, len(u))
                rhat[lo:hi] = np.einsum("ij,ij->i", x[u[lo:hi]], y[o[lo:hi]])
            wr = w * r
            yt = np.ascontiguousarray(y.T)  # one coordinate of all vectors per row
            for f in range(k):
                yf = yt[f][o]
                rf = rhat - x[u, f] * yf
                num = np.bincount(u, weights=(wr - wmc * rf) * yf, minlength=n_e)
                den = np.bincount(u, weights=wmc * yf * yf, minlength=n_e)
                cache = mult * (x @ s[:, f] - x[:, f] * s_diag[f])
                new = (num - cache) / (den + mult * s_diag[f] + lam)
                new = np.where(has, new, x[:, f])
                x[:, f] = new
                rhat = rf + new[u] * yf
        keep = ~skip
        return _vec_frame(e_ids[keep], x[keep].astype(out_dtype))
    return run


def _heavy_partial(k: int, w: float, r: float, groups: int):
    upper = np.triu_indices(k)

    def run(rows: pd.DataFrame, vecs: pd.DataFrame) -> pd.DataFrame:
        """``rows``: part, e, o, c of one part; ``vecs``: the part's vectors."""
        out_e, out_v = [], []
        if len(rows):
            ids = vecs["o"].to_numpy()
            order = np.argsort(ids, kind="stable")
            y = np.vstack(vecs["vec"].to_numpy()[order]).astype(np.float64)
            at = np.searchsorted(ids[order], rows["o"].to_numpy())
            e, c = rows["e"].to_numpy(), rows["c"].to_numpy(dtype=np.float64)
            by_e = np.argsort(e, kind="stable")
            starts = np.nonzero(np.diff(e[by_e], prepend=e[by_e[0]] - 1))[0]
            for lo, hi in zip(starts, [*starts[1:], len(e)]):
                own = by_e[lo:hi]
                yo = y[at[own]]
                a = yo.T @ (yo * (w - c[own])[:, None])
                out_e.append(int(e[own[0]]))
                out_v.append(np.concatenate([a[upper], w * r * yo.sum(axis=0)]))
        group = (int(rows["part"].iloc[0]) & ((1 << _CELL_BITS) - 1)) % groups if len(rows) else 0
        return pd.DataFrame({"e": np.array(out_e, np.int64),
                             "g": np.full(len(out_e), group, np.int32),
                             "sums": pd.Series(out_v, dtype=object)})
    return run


def _add_sums(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"e": frame["e"].iloc[:1], "sums": [np.sum(np.stack(frame["sums"]), axis=0)]})


def _heavy_solve(s: np.ndarray, lam: float, dtype: str):
    k = s.shape[0]
    out_dtype = np.float32 if dtype == "float32" else np.float64
    iu, ju = np.triu_indices(k)

    def run(sums: pd.DataFrame, cur: pd.DataFrame) -> pd.DataFrame:
        if len(cur) == 0:
            return _vec_frame(np.zeros(0), np.zeros((0, k)))
        x = np.asarray(cur["vec"].iloc[0], dtype=np.float64).copy()
        m = float(cur["m"].iloc[0])
        total = np.zeros(len(iu) + k)
        for part in sums["sums"]:
            total += part
        a = np.zeros((k, k))
        a[iu, ju] = a[ju, iu] = total[:len(iu)]
        b = total[len(iu):]
        t = a + m * s
        for j in range(k):
            x[j] = (b[j] - (t[j] @ x - t[j, j] * x[j])) / (t[j, j] + lam)
        return _vec_frame(np.array([int(cur["e"].iloc[0])]), x.astype(out_dtype)[None, :])
    return run


def half_step(layout: SideLayout, vecs: DataFrame, other: DataFrame, s: np.ndarray,
              reg_lambda: float, observed_weight: float = 1.0, observed_value: float = 1.0,
              dtype: str = "float32") -> DataFrame:
    """M3 (side="user") / M4 (side="item") + M5: new ``idx, vec`` for all rows of ``vecs``."""
    k = s.shape[0]
    vt = vec_type(dtype)
    out_schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("vec", vt)])
    # only vectors move: the static history side is bucketed by blk already
    ents = layout.packing.with_block(vecs, "idx").select(
        "blk", F.lit(0).alias("kind"), F.col("idx").alias("id"), F.col("vec").cast(vt).alias("vec"))
    routed = layout.routing.join(
        other.select(F.col("idx").alias("o"), F.col("vec").cast(vt).alias("vec")), "o"
    ).select("blk", F.lit(1).alias("kind"), F.col("o").alias("id"), "vec")
    moving = ents.unionByName(routed)
    out = (layout.light.groupBy("blk").cogroup(moving.groupBy("blk"))
           .applyInPandas(_block_kernel(layout.side, s, reg_lambda, observed_weight,
                                        observed_value, dtype), out_schema))
    if layout.heavy is None:
        return out
    groups = layout.heavy_groups
    # one vector per part that needs it; the rows are bucketed by part already
    sent = layout.heavy_routing.join(
        other.select(F.col("idx").alias("o"), F.col("vec").cast(vt).alias("vec")), "o")
    sums = (layout.heavy.groupBy("part").cogroup(sent.groupBy("part"))
            .applyInPandas(_heavy_partial(k, observed_weight, observed_value, groups),
                           "e bigint, g int, sums array<double>"))
    if groups > 1:  # two levels: no task adds up more than about sqrt(splits) rows of an entity
        sums = sums.groupBy("e", "g").applyInPandas(_add_sums, "e bigint, sums array<double>")
    cur = (vecs.select(F.col("idx").alias("e"), F.col("vec").cast(vt).alias("vec"))
           .join(layout.heavy_keys.select("e", "m"), "e"))
    if layout.side == "user":
        cur = cur.withColumn("m", F.lit(1.0))
    solved = (sums.groupBy("e").cogroup(cur.groupBy("e"))
              .applyInPandas(_heavy_solve(s, reg_lambda, dtype), out_schema))
    return out.unionByName(solved)
