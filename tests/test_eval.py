"""Evaluation: HR/NDCG golden values, held-out rank and top-K against brute force."""

import math

import numpy as np
import pytest

from fernrec.operators.scoring import (heldout_rank, hr_ndcg, recommend_topk, sample_users,
                                       summarize)

VEC = "idx bigint, vec array<double>"


def test_metric_golden(spark):
    ranks = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 100), (4, 101)],
                                  "user_idx bigint, rank bigint")
    got = {r.user_idx: (r.hr, r.ndcg) for r in hr_ndcg(ranks, 100).collect()}
    assert got[0] == (1.0, 1.0)
    assert got[1][1] == pytest.approx(0.630930, abs=1e-6)
    assert got[2][1] == pytest.approx(0.5)
    assert got[3][1] == pytest.approx(0.150190, abs=1e-6)
    assert got[4] == (0.0, 0.0)
    k0 = {r.user_idx: (r.hr, r.ndcg) for r in hr_ndcg(ranks, 0).collect()}
    assert all(v == (0.0, 0.0) for v in k0.values())
    empty = summarize(hr_ndcg(ranks.limit(0), 10)).first()
    assert (empty.hr, empty.ndcg, empty.evaluated_users) == (0.0, 0.0, 0)


def setup_model(spark, n_u=23, n_i=37, k=3, seed=3, ties=False):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n_u, k))
    q = rng.normal(size=(n_i, k))
    if ties:
        q = np.round(q, 0)  # many exactly equal scores
        p = np.round(p, 0)
    train = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, n_u, 120),
                                                     rng.integers(0, n_i, 120))})
    tset = set(train)
    test = []
    for u in range(n_u):
        cand = [i for i in range(n_i) if (u, i) not in tset]
        test.append((u, int(rng.choice(cand))))
    P = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], VEC)
    Q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], VEC)
    T = spark.createDataFrame(train, "user_idx bigint, item_idx bigint")
    X = spark.createDataFrame([(u, i, 0) for u, i in test],
                              "user_idx bigint, test_item_idx bigint, n_train bigint")
    return p, q, train, test, P, Q, T, X


def brute_rank(p, q, train, test):
    tset = set(train)
    out = {}
    for u, t in test:
        s = q @ p[u]
        items = [j for j in range(len(q)) if (u, j) not in tset]
        order = sorted(items, key=lambda j: (-s[j], j))
        out[u] = order.index(t) + 1
    return out


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("blocks", [(4096, 8192), (5, 7)])
def test_heldout_rank_brute_force(spark, ties, blocks):
    p, q, train, test, P, Q, T, X = setup_model(spark, ties=ties)
    got = {r.user_idx: r.rank for r in heldout_rank(X, T, P, Q, len(p), len(q),
                                                    *blocks).collect()}
    assert got == brute_rank(p, q, train, test)


@pytest.mark.parametrize("blocks", [(4096, 8192), (4, 6), (4, 1)])
def test_recommend_topk_brute_force(spark, blocks):
    """(4, 1): one item per block, 37 blocks; with the fan-in lowered below
    the two-level merge runs."""
    from fernrec.operators import scoring as SC
    if blocks[1] == 1:
        saved, SC._MERGE_FANIN = SC._MERGE_FANIN, 4
    else:
        saved = SC._MERGE_FANIN
    try:
        _check_topk(spark, blocks)
    finally:
        SC._MERGE_FANIN = saved


def _check_topk(spark, blocks):
    p, q, train, test, P, Q, T, X = setup_model(spark)
    k = 5
    got = {}
    for r in recommend_topk(X, T, P, Q, k, len(p), len(q), *blocks).collect():
        got.setdefault(r.user_idx, []).append((r.rank, r.item_idx))
    tset = set(train)
    for u in range(len(p)):
        s = q @ p[u]
        items = sorted((j for j in range(len(q)) if (u, j) not in tset), key=lambda j: (-s[j], j))
        assert [j for _, j in sorted(got[u])] == items[:k]


def test_ndcg_matches_rank(spark):
    p, q, train, test, P, Q, T, X = setup_model(spark)
    ranks = heldout_rank(X, T, P, Q, len(p), len(q))
    for r in hr_ndcg(ranks, 10).collect():
        if r.rank <= 10:
            assert r.ndcg == pytest.approx(1 / math.log2(r.rank + 1))
            assert r.hr == 1.0
        else:
            assert (r.hr, r.ndcg) == (0.0, 0.0)


def test_sample_users(spark):
    X = spark.createDataFrame([(u, 0, 0) for u in range(40)],
                              "user_idx bigint, test_item_idx bigint, n_train bigint")
    a = sorted(r.user_idx for r in sample_users(X, 10, 42).collect())
    b = sorted(r.user_idx for r in sample_users(X.repartition(3), 10, 42).collect())
    assert a == b and len(a) == 10
    assert sample_users(X, 100, 42).count() == 40
    assert sample_users(X, None, 42).count() == 40
    assert sorted(r.user_idx for r in sample_users(X, 10, 7).collect()) != a


def test_rank_of_a_user_subset_ignores_other_train_rows(spark):
    """Train pairs of users outside the evaluated set must not mask anything."""
    p, q, train, test, P, Q, T, X = setup_model(spark)
    subset = X.filter("user_idx % 3 = 0")
    got = {r.user_idx: r.rank for r in heldout_rank(subset, T, P, Q, len(p), len(q),
                                                    5, 7).collect()}
    full = brute_rank(p, q, train, test)
    assert got == {u: r for u, r in full.items() if u % 3 == 0}


def test_evaluate_with_sample(spark):
    from fernrec.operators.scoring import evaluate
    p, q, train, test, P, Q, T, X = setup_model(spark)
    per_user, summary = evaluate(X, T, P, Q, 10, len(p), len(q), sample=7, seed=1,
                                 block_users=5, block_items=7)
    full = brute_rank(p, q, train, test)
    rows = per_user.collect()
    assert len(rows) == 7 and all(r.rank == full[r.user_idx] for r in rows)
    assert summary.first().evaluated_users == 7


def test_metrics_agree_with_ranking_evaluator(spark):
    """HR@K / NDCG@K from the held-out rank equal Spark ML's recallAtK /
    ndcgAtK on the top-K lists (one relevant item per user)."""
    from pyspark.ml.evaluation import RankingEvaluator
    from pyspark.sql import functions as F
    p, q, train, test, P, Q, T, X = setup_model(spark, n_u=40, n_i=50, seed=11)
    k = 6
    ours = summarize(hr_ndcg(heldout_rank(X, T, P, Q, len(p), len(q), 7, 9), k)).first()
    rec = recommend_topk(X, T, P, Q, k, len(p), len(q), 7, 9)
    lists = (rec.groupBy("user_idx")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "item_idx"))).alias("r"))
             .select("user_idx", F.transform("r", lambda x: x["item_idx"].cast("double"))
                     .alias("prediction")))
    data = lists.join(X.select("user_idx", F.array(F.col("test_item_idx").cast("double"))
                               .alias("label")), "user_idx")
    recall = RankingEvaluator(metricName="recallAtK", k=k).evaluate(data)
    ndcg = RankingEvaluator(metricName="ndcgAtK", k=k).evaluate(data)
    assert ours.hr == pytest.approx(recall, abs=1e-12)
    assert ours.ndcg == pytest.approx(ndcg, abs=1e-12)
    assert 0 < ours.hr < 1


@pytest.mark.parametrize("k", [4, 16, 64])
@pytest.mark.parametrize("blocks", [(4096, 8192), (7, 5)])
def test_equal_real_scores(spark, k, blocks):
    """Every item has a twin with the same real-valued vector; the held-out
    item is the later twin, so the earlier one always ranks before it."""
    rng = np.random.default_rng(k)
    half = rng.normal(size=(20, k))
    q = np.concatenate([half, half])
    p = rng.normal(size=(30, k))
    P = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], VEC)
    Q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], VEC)
    T = spark.createDataFrame([], "user_idx bigint, item_idx bigint")
    X = spark.createDataFrame([(u, 20 + u % 20) for u in range(30)],
                              "user_idx bigint, test_item_idx bigint")
    ranks = {r.user_idx: r.rank for r in heldout_rank(X, T, P, Q, 30, 40, *blocks).collect()}
    top = {}
    for r in recommend_topk(X, T, P, Q, 40, 30, 40, *blocks).collect():
        top.setdefault(r.user_idx, {})[r.item_idx] = r.rank
    for u in range(30):
        t = 20 + u % 20
        s = half @ p[u]
        assert ranks[u] == top[u][t] == 2 * int((s > s[u % 20]).sum()) + 2
        assert top[u][t - 20] == top[u][t] - 1


def test_item_copies_follow_the_sample(spark):
    from fernrec.operators import scoring as SC
    p, q, train, test, P, Q, T, X = setup_model(spark)
    made = []
    saved = SC._cells
    SC._cells = lambda *a: made.append(saved(*a)) or made[-1]
    try:
        per_user, summary = SC.evaluate(X, T, P, Q, 5, 10**6, len(q), sample=4, block_users=2,
                                        block_items=10)
        assert summary.first().evaluated_users == 4 and per_user.count() == 4
        assert made[0][1].count() == 2 * len(q)
    finally:
        SC._cells = saved


def test_missing_vectors_and_bad_scores_raise(spark):
    p, q, train, test, P, Q, T, X = setup_model(spark)
    with pytest.raises(Exception, match="no factor vector"):
        heldout_rank(X, T, P.filter("idx <> 3"), Q, len(p), len(q)).collect()
    bad = spark.createDataFrame([(i, [float("nan")] * 3) for i in range(len(q))], VEC)
    with pytest.raises(Exception, match="not finite"):
        heldout_rank(X, T, P, bad, len(p), len(q)).collect()
    with pytest.raises(Exception, match="not finite"):
        recommend_topk(X, T, P, bad, 5, len(p), len(q)).collect()
