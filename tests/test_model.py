"""Factor init, Gram matrices and coordinate half-steps."""

import numpy as np
import pytest

from fernrec.operators.factors import gram_matrix, init_factors
from fernrec.operators.halfstep import build_layout, half_step

VEC = "idx bigint, vec array<double>"


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], VEC)


def as_matrix(df, n, k):
    m = np.zeros((n, k))
    for r in df.collect():
        m[r.idx] = r.vec
    return m


def test_init_is_deterministic_and_normal(spark):
    ids = spark.range(0, 4000).withColumnRenamed("id", "user_idx")
    a = init_factors(ids, "user_idx", 8, 42, "user", 0.0, 1.0, "float64")
    b = init_factors(ids.repartition(5), "user_idx", 8, 42, "user", 0.0, 1.0, "float64")
    ma, mb = as_matrix(a, 4000, 8), as_matrix(b, 4000, 8)
    assert np.array_equal(ma, mb)
    assert abs(ma.mean()) < 0.05 and abs(ma.std() - 1.0) < 0.05
    other = as_matrix(init_factors(ids, "user_idx", 8, 42, "item", 0.0, 1.0, "float64"), 4000, 8)
    assert not np.allclose(ma, other)


def test_gram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 5))
    c = rng.uniform(size=50)
    f = vecs(spark, list(enumerate(x))).repartition(4)
    w = spark.createDataFrame([(i, float(c[i])) for i in range(40)], "item_idx bigint, c double")
    c40 = np.where(np.arange(50) < 40, c, 0.0)
    assert np.allclose(gram_matrix(f, 5, w), x.T @ (x * c40[:, None]))
    assert np.allclose(gram_matrix(f, 5), x.T @ x)


def test_half_step_golden(spark):
    """K=1, lambda=0.5, one user with item 0 (c=0.2); q0=1, q1=2 (c=0.1)."""
    hist = spark.createDataFrame([(0, 0, 0.2)], "user_idx bigint, item_idx bigint, c double")
    weights = spark.createDataFrame([(0, 0.2), (1, 0.1)], "item_idx bigint, c double")
    q = vecs(spark, [(0, [1.0]), (1, [2.0])])
    s = gram_matrix(q, 1, weights)
    assert np.allclose(s, [[0.6]])
    layout = build_layout(hist, "user", heavy_threshold=100, rows_per_block=10)
    for p0 in (0.0, 7.0):
        p = vecs(spark, [(0, [p0]), (1, [3.0])])
        out = {r.idx: r.vec for r in half_step(layout, p, q, s, 0.5, dtype="float64").collect()}
        assert out[0][0] == pytest.approx(0.526316, abs=1e-6)
        assert out[1][0] == 3.0  # no history: vector kept


def scalar_sweep(x, y, hist, s, lam, w, r, side, c_item):
    """Per-entity scalar sweep written from the update equations."""
    x = x.copy()
    k = x.shape[1]
    for e in sorted({h[0] for h in hist}):
        rows = [(o, c) for ee, o, c in hist if ee == e]
        mult = c_item[e] if side == "item" else 1.0
        for f in range(k):
            num = den = 0.0
            for o, c in rows:
                rf = x[e] @ y[o] - x[e, f] * y[o, f]
                num += (w * r - (w - c) * rf) * y[o, f]
                den += (w - c) * y[o, f] ** 2
            cache = mult * (x[e] @ s[:, f] - x[e, f] * s[f, f])
            x[e, f] = (num - cache) / (den + mult * s[f, f] + lam)
    return x


@pytest.mark.parametrize("heavy_threshold", [1000, 3])
@pytest.mark.parametrize("side", ["user", "item"])
def test_half_step_matches_scalar_sweep(spark, side, heavy_threshold):
    rng = np.random.default_rng(1)
    n_u, n_i, k = 30, 12, 4
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, n_u, 150),
                                                     rng.integers(0, n_i, 150))})
    c_item = rng.uniform(0.05, 2.0, size=n_i)
    hist_rows = [(u, i, float(c_item[i])) for u, i in pairs]
    hist = spark.createDataFrame(hist_rows, "user_idx bigint, item_idx bigint, c double")
    p = rng.normal(size=(n_u, k))
    q = rng.normal(size=(n_i, k))
    layout = build_layout(hist, side, heavy_threshold=heavy_threshold, rows_per_block=40)
    if heavy_threshold == 3:
        assert layout.heavy_entities > 0
    if side == "user":
        s = q.T @ (q * c_item[:, None])
        out = half_step(layout, vecs(spark, enumerate(p)), vecs(spark, enumerate(q)), s, 0.1,
                        dtype="float64")
        expected = scalar_sweep(p, q, [(u, i, c) for u, i, c in hist_rows], s, 0.1, 1.0, 1.0,
                                   "user", c_item)
        got = as_matrix(out, n_u, k)
    else:
        s = p.T @ p
        out = half_step(layout, vecs(spark, enumerate(q)), vecs(spark, enumerate(p)), s, 0.1,
                        dtype="float64")
        expected = scalar_sweep(q, p, [(i, u, c) for u, i, c in hist_rows], s, 0.1, 1.0, 1.0,
                                   "item", c_item)
        got = as_matrix(out, n_i, k)
    assert out.count() == (n_u if side == "user" else n_i)
    assert np.allclose(got, expected, atol=1e-9)


def test_hot_item_and_hot_user(spark):
    """One item holds a third of all rows and one user rates most items: both
    take the chunked partial-sum path and agree with the scalar sweep."""
    rng = np.random.default_rng(7)
    n_u, n_i, k = 60, 40, 3
    pairs = {(u, 0) for u in range(n_u)}                      # hot item 0
    pairs |= {(0, i) for i in range(n_i)}                     # hot user 0
    while len(pairs) < 3 * n_u:
        pairs.add((int(rng.integers(1, n_u)), int(rng.integers(1, n_i))))
    pairs = sorted(pairs)
    assert sum(1 for _, i in pairs if i == 0) * 3 >= len(pairs)
    c_item = rng.uniform(0.05, 2.0, size=n_i)
    rows = [(u, i, float(c_item[i])) for u, i in pairs]
    hist = spark.createDataFrame(rows, "user_idx bigint, item_idx bigint, c double")
    p = rng.normal(size=(n_u, k))
    q = rng.normal(size=(n_i, k))
    for side in ("user", "item"):
        layout = build_layout(hist, side, heavy_threshold=20, rows_per_block=30,
                              heavy_chunk_rows=7)
        assert layout.heavy_entities >= 1
        if side == "user":
            s = q.T @ (q * c_item[:, None])
            out = half_step(layout, vecs(spark, enumerate(p)), vecs(spark, enumerate(q)), s,
                            0.1, dtype="float64")
            exp = scalar_sweep(p, q, rows, s, 0.1, 1.0, 1.0, "user", c_item)
            assert np.allclose(as_matrix(out, n_u, k), exp, atol=1e-9)
        else:
            s = p.T @ p
            out = half_step(layout, vecs(spark, enumerate(q)), vecs(spark, enumerate(p)), s,
                            0.1, dtype="float64")
            exp = scalar_sweep(q, p, [(i, u, c) for u, i, c in rows], s, 0.1, 1.0, 1.0,
                                  "item", c_item)
            assert np.allclose(as_matrix(out, n_i, k), exp, atol=1e-9)


def test_empty_inputs(spark):
    """No history: vectors are kept; no test users: zero metrics, no rows."""
    from fernrec.operators.scoring import evaluate, recommend_topk
    hist = spark.createDataFrame([], "user_idx bigint, item_idx bigint, c double")
    v = vecs(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])])
    layout = build_layout(hist, "user", 10, 10)
    assert layout.light_rows == 0
    out = sorted((r.idx, list(r.vec)) for r in
                 half_step(layout, v, v, np.eye(2), 0.1, dtype="float64").collect())
    assert out == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    test = spark.createDataFrame([], "user_idx bigint, test_item_idx bigint, n_train bigint")
    train = spark.createDataFrame([], "user_idx bigint, item_idx bigint")
    per_user, summary = evaluate(test, train, v, v, 10, 0, 2)
    row = summary.first()
    assert (row.hr, row.ndcg, row.evaluated_users) == (0.0, 0.0, 0)
    assert per_user.count() == 0
    assert recommend_topk(test, train, v, v, 5, 0, 2).count() == 0


def test_layout_release_deletes_tables(spark):
    import os
    from fernrec.operators.halfstep import release_layout
    rows = [(u, i, 0.5) for u in range(20) for i in range(u % 5, u % 5 + 4)]
    hist = spark.createDataFrame(rows, "user_idx bigint, item_idx bigint, c double")
    layout = build_layout(hist, "user", heavy_threshold=3, rows_per_block=10)
    assert layout.heavy_entities > 0
    paths = {f.rsplit("/", 1)[0].replace("file:", "") for df in
             (layout.light, layout.routing, layout.heavy, layout.heavy_keys)
             for f in df.inputFiles()}
    tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("fernrec_")}
    release_layout(layout)
    assert not any(os.path.exists(p) for p in paths)
    after = {t.name for t in spark.catalog.listTables() if t.name.startswith("fernrec_")}
    assert len(after) == len(tables) - 2  # light and heavy rows


def test_blocks_are_bounded_and_dealt_evenly(spark):
    """No block has more rows than rows_per_block and one entity; every bucket
    of the table has the same number of blocks."""
    from fernrec.operators.packing import bucket_labels
    rng = np.random.default_rng(3)
    sizes = rng.zipf(1.5, size=300).clip(0, 60) * (rng.random(300) < 0.8)
    rows = [(u, i, 0.5) for u, n in enumerate(sizes) for i in range(n)]
    hist = spark.createDataFrame(rows, "user_idx bigint, item_idx bigint, c double")
    layout = build_layout(hist, "user", heavy_threshold=1000, rows_per_block=50, num_entities=300)
    held = layout.light.groupBy("blk").count().collect()
    assert sum(r["count"] for r in held) == len(rows) and layout.blocks >= len(rows) / 110
    assert max(r["count"] for r in held) <= 50 + 60
    # entities without rows count, too
    every = layout.packing.with_block(spark.range(310), "id").groupBy("blk").count().collect()
    assert sum(r["count"] for r in every) == 310 and max(r["count"] for r in every) <= 50 + 1 + 10
    labels = bucket_labels(spark, 20, 8)
    dealt = labels.selectExpr("pmod(hash(label), 8) AS p", "no").collect()
    assert sorted(r.no for r in dealt) == list(range(20)) and all(r.no % 8 == r.p for r in dealt)


def test_small_blocks_share_tasks(spark):
    """Tasks follow the rows, not the number of small blocks; blocks stay bounded."""
    from fernrec.operators.packing import pack
    weights = spark.range(5000).selectExpr("id AS e", "3L AS n")
    packing = pack(weights, 5000, 20)
    tasks = max(spark.sparkContext.defaultParallelism, 8)
    assert packing.blocks >= 1000 and packing.buckets <= tasks
    held = packing.with_block(weights, "e").groupBy("blk").count().selectExpr(
        "blk", "count", f"pmod(hash(blk), {packing.buckets}) AS p").collect()
    assert len(held) == packing.blocks and max(r["count"] for r in held) <= 6
    per_task = [sum(r.p == k for r in held) for k in range(packing.buckets)]
    assert max(per_task) - min(per_task) <= 1


def test_half_steps_share_their_layouts(spark, monkeypatch):
    """Queries on one training iteration build the layouts once."""
    from conftest import SF001
    from fernrec.plans import catalog
    made, build = [], catalog.layouts
    monkeypatch.setattr(catalog, "_cache", {})
    monkeypatch.setattr(catalog, "layouts", lambda *a: made.append(a) or build(*a))
    catalog.q_item_half_step(spark, SF001)
    catalog.q_user_half_step(spark, SF001)
    assert len(made) == 1


def test_many_medium_heavy_entities(spark):
    """A thousand heavy entities: partial rows follow rows / chunk, parts stay
    small, and the step is the scalar sweep."""
    rng = np.random.default_rng(4)
    n_e, n_o, k, chunk = 1000, 60, 2, 10
    sizes = rng.integers(21, 45, size=n_e)
    rows = [(u, int(i), 0.25) for u, n in enumerate(sizes) for i in rng.permutation(n_o)[:n]]
    hist = spark.createDataFrame(rows, "user_idx bigint, item_idx bigint, c double")
    layout = build_layout(hist, "user", heavy_threshold=20, rows_per_block=40,
                          heavy_chunk_rows=chunk, num_entities=n_e)
    assert layout.heavy_entities == n_e and layout.heavy.count() == len(rows)
    partial = layout.heavy.select("part", "e").distinct().count()
    assert partial <= 2 * len(rows) / chunk
    assert layout.heavy.groupBy("part", "e").count().agg({"count": "max"}).first()[0] <= 3 * chunk
    assert layout.heavy.groupBy("part").count().agg({"count": "max"}).first()[0] <= 3 * 40
    p, q = rng.normal(size=(n_e, k)), rng.normal(size=(n_o, k))
    s = q.T @ q
    out = half_step(layout, vecs(spark, enumerate(p)), vecs(spark, enumerate(q)), s, 0.1,
                    dtype="float64")
    exp = scalar_sweep(p, q, rows, s, 0.1, 1.0, 1.0, "user", np.full(n_o, 0.25))
    assert np.allclose(as_matrix(out, n_e, k), exp, atol=1e-9)
