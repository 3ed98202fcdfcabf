"""Selection without a sort, hot-id joins, byte-range sampling and pruned top-K."""

import os
import statistics
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

VEC = "idx bigint, vec array<double>"


@pytest.mark.parametrize("digits, pick", [(3, 4096), (1, 1), (3, 1)])
def test_select_smallest(spark, digits, pick):
    from fernrec.operators.selection import select_smallest
    df = spark.range(0, 3000).select(F.md5(F.col("id").cast("string")).alias("k"),
                                     "id").repartition(5)
    rows = sorted((r.k, r.id) for r in df.collect())
    for n in (0, 1, 17, 2999, 3000, 5000):
        got = sorted((r.k, r.id) for r in select_smallest(df, "k", ["id"], n, digits, pick).collect())
        assert got == rows[:n]
    assert select_smallest(df.limit(0), "k", ["id"], 5).count() == 0


def test_select_smallest_repeated_keys(spark):
    """Equal keys stay in one bin to the last digit; rows count one by one."""
    from fernrec.operators.selection import select_smallest
    df = spark.range(0, 90).select(F.md5((F.col("id") % 3).cast("string")).alias("k"),
                                   (F.col("id") % 6).alias("id"))
    rows = sorted((r.k, r.id) for r in df.collect())
    for pick in (4096, 10):
        got = sorted((r.k, r.id) for r in select_smallest(df, "k", ["id"], 40, 3, pick).collect())
        assert got == rows[:40]


def _interactions(spark, n=24_000):
    """One user holds a third of all rows and one item, over other users, a sixth."""
    i = F.col("id")
    user = F.when(i % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(2000)).cast("string")))
    item = F.when(i % 6 == 1, F.lit("top")).otherwise(
        F.concat(F.lit("i"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3000)).cast("string")))
    return spark.range(0, n, 1, 8).select(user.alias("user_id"), item.alias("item_id"),
                                          i.alias("ts"))


def test_hot_ids(spark):
    from fernrec.operators.hotjoin import hot_ids
    df = _interactions(spark)
    assert hot_ids(df, ["user_id", "item_id"]) == {"user_id": ["hot"], "item_id": ["top"]}
    assert hot_ids(df.limit(0), ["user_id"]) == {"user_id": []}
    nulls = spark.range(0, 100).select(F.lit(None).cast("string").alias("user_id"))
    assert hot_ids(nulls, ["user_id"]) == {"user_id": []}


def test_lookup_equals_plain_join_and_is_even(spark):
    """Null and unknown ids drop out as in an inner join; no task gets twice the median."""
    from fernrec.operators.hotjoin import lookup
    from fernrec.operators.prepare import dense_index
    from fernrec.session import materialize
    df, _ = materialize(_interactions(spark).unionByName(spark.createDataFrame(
        [(None, "top", 1), ("hot", None, 2), ("u1", "nowhere", 3)],
        "user_id string, item_id string, ts bigint")), "hot_test")
    users, _ = materialize(dense_index(df, "user_id", "user_idx"), "hot_users")
    items, _ = materialize(dense_index(df.filter("item_id <> 'nowhere'"), "item_id", "item_idx"),
                           "hot_items")
    got = lookup(df, {"user_id": users, "item_id": items})
    exp = df.join(users, "user_id").join(items, "item_id").select(*got.columns)
    assert got.count() == exp.count() == 24_000
    assert got.exceptAll(exp).count() == exp.exceptAll(got).count() == 0

    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",
                                            "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in lookup(df, {"user_id": users, "item_id": items})
                 .groupBy(F.spark_partition_id().alias("task")).count().collect()]
        one = lookup(df, {"user_id": users}).groupBy(
            F.spark_partition_id().alias("task")).count().collect()
        plain = [r["count"] for r in df.join(users, "user_id").groupBy(
            F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    one = [r["count"] for r in one]
    assert max(plain) > 2 * statistics.median(plain)
    assert max(one) <= 2 * statistics.median(one)
    assert max(sizes) < max(plain) / 2


def _file(text: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="fernrec-range-"), "reviews.txt")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def _read_bytes(spark) -> int:
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in stats if s.getScheme() == "file")


def test_first_records_by_ranges_equal_the_batch_way(spark, monkeypatch):
    from fernrec.sources import text as X
    rng = np.random.default_rng(5)
    seps = ["\n\n", "\n\n\n", "\n \n", "\r\n\r\n", "\n \t\n\n", "\n\n\n\n\n"]
    text = "".join(f"product/productId: I{i}\n  review/summary: {'ä' * int(rng.integers(0, 60))}"
                   f"{seps[int(rng.integers(0, len(seps)))]}" for i in range(40)) + "\n \n"
    path = _file(text)
    exp = [(r.pos, r.value) for r in X.sample_first_records(spark, path, 10_000).orderBy("pos").collect()]
    assert [p for p, _ in exp] == list(range(40))
    for size, ns in ((61, (20,)), (500, (0, 1, 39, 40, 41))):
        monkeypatch.setattr(X, "RANGE_BYTES", size)
        monkeypatch.setattr(X, "_MOST_RANGES", 1 << 20)
        for n in ns:
            got = X.sample_first_records(spark, path, n).orderBy("pos").collect()
            assert [(r.pos, r.value) for r in got] == exp[:n]


def test_first_records_of_small_and_large_files(spark, monkeypatch):
    from fernrec.sources import text as X
    d = tempfile.mkdtemp(prefix="fernrec-mixed-")
    at = 0
    for name, rows in (("a", 3), ("b", 90), ("c", 2), ("d", 4), ("e", 80)):
        with open(os.path.join(d, f"{name} 1.txt"), "w", encoding="utf-8") as f:
            f.write("\n\n".join(f"review/time: {at + i}" for i in range(rows)))
        at += rows
    monkeypatch.setattr(X, "RANGE_BYTES", 500)
    for n in (2, 97, 500):
        got = X.sample_first_records(spark, d, n).orderBy("pos").collect()
        assert [(r.pos, r.value) for r in got] == [(i, f"review/time: {i}")
                                                   for i in range(min(n, at))]


def test_bytes_read_grow_with_the_sample(spark, monkeypatch):
    from fernrec.sources import text as X
    path = _file("\n\n".join(f"review/time: {i}\nreview/text: {'x' * 4000}" for i in range(25_000)))
    size = os.path.getsize(path)
    read = []
    for n in (100, 9_000):
        before = _read_bytes(spark)
        assert X.sample_first_records(spark, path, n).count() == n
        read.append(_read_bytes(spark) - before)
    assert read[0] < size / 4 and read[0] < read[1] / 2, (read, size)


def _model(spark, n_u, n_i, k, spread, seed, ties=False):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(size=(n_u, k)), rng.normal(size=(n_i, k))
    q *= (spread ** -rng.random(n_i))[:, None]
    if ties:
        p, q = np.round(p), np.round(q)
    train = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, n_u, 8 * n_u),
                                                     rng.integers(0, n_i, 8 * n_u))})
    P = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], VEC)
    Q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], VEC)
    return p, q, set(train), P, Q, spark.createDataFrame(train, "user_idx bigint, item_idx bigint")


@pytest.mark.parametrize("ties, k, block", [(False, 5, 4), (True, 7, 4), (True, 500, 16)])
def test_pruned_topk_brute_force(spark, ties, k, block):
    from fernrec.operators.topk import recommend_pruned
    p, q, train, P, Q, T = _model(spark, 25, 120, 3, 1000.0, 2, ties)
    rec = recommend_pruned(P.select(F.col("idx").alias("user_idx")), T, P, Q, k, 10, block)
    got = {}
    for r in rec.frame.collect():
        got.setdefault(r.user_idx, []).append((r.rank, r.item_idx, r.score))
    for u in range(len(p)):
        s = [float(np.sum([0.0] + [a * b for a, b in zip(p[u], row)])) for row in q]
        items = sorted((j for j in range(len(q)) if (u, j) not in train), key=lambda j: (-s[j], j))
        own = sorted(got[u])
        assert [j for _, j, _ in own] == items[:k]
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert [v for _, _, v in own] == pytest.approx([s[j] for j in items[:k]])
    assert rec.scored + rec.skipped == 25 * rec.blocks


def test_pruned_topk_skips_blocks(spark, monkeypatch):
    """Uneven norms close most users early, also with one bound for many blocks."""
    from fernrec.operators import topk as K
    from fernrec.operators.scoring import recommend_topk
    p, q, train, P, Q, T = _model(spark, 60, 800, 4, 10_000.0, 7)
    users = P.select(F.col("idx").alias("user_idx"))
    exp = sorted(map(tuple, recommend_topk(users, T, P, Q, 10, 60, 800, 20, 100).collect()))
    for bounds in (256, 2):
        monkeypatch.setattr(K, "_BOUNDS", bounds)
        rec = K.recommend_pruned(users, T, P, Q, 10, 20, 8)
        assert sorted(map(tuple, rec.frame.collect())) == exp
        assert rec.blocks == 100 and rec.skipped > 60 * 100 / 2


def test_pruned_topk_edges(spark):
    from fernrec.operators.topk import recommend_pruned
    p, q, train, P, Q, T = _model(spark, 6, 9, 2, 10.0, 1)
    users = P.select(F.col("idx").alias("user_idx"))
    assert recommend_pruned(users.limit(0), T, P, Q, 3).frame.count() == 0
    assert recommend_pruned(users, T, P, Q.limit(0), 3).frame.count() == 0
    assert recommend_pruned(users, T, P, Q, 0).frame.count() == 0
    zero = Q.select("idx", F.transform("vec", lambda x: x * 0).alias("vec"))
    rows = recommend_pruned(users, T.limit(0), P, zero, 2, 4, 3).frame.collect()
    assert sorted((r.user_idx, r.item_idx) for r in rows) == [(u, j) for u in range(6) for j in (0, 1)]
    with pytest.raises(Exception, match="no factor vector"):
        recommend_pruned(users, T, P.filter("idx <> 3"), Q, 3).frame.collect()
    bad = Q.withColumn("vec", F.when(F.col("idx") == 8, F.array(F.lit(float("nan")), F.lit(0.0)))
                       .otherwise(F.col("vec")))
    with pytest.raises(Exception, match="not finite"):
        recommend_pruned(users, T, P, bad, 3).frame.collect()
