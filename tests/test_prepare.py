"""Preparation operators: golden cases and brute-force properties."""

import pytest

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from fernrec.operators.prepare import (KCoreLimitError, dedup_latest, dense_index, k_core,
                                       leave_one_out)
from fernrec.operators.weights import all_item_weights, item_weights


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id string, item_id string, ts bigint")


def test_dedup_golden(spark):
    df = frame(spark, [("u", "i", 3), ("u", "i", 9), ("u", "i", 5), ("u", "j", 1)])
    assert sorted(tuple(r) for r in dedup_latest(df).collect()) == [("u", "i", 9), ("u", "j", 1)]


def test_k_core_cascade(spark):
    rows = [("a", "x", 0), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0), ("c", "x", 0),
            ("c", "z", 0)]
    res = k_core(frame(spark, rows), 2, 2)
    assert res.counts == [6, 5, 4, 4]
    got = sorted((r.user_id, r.item_id) for r in res.interactions.collect())
    assert got == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_k_core_limit_raises(spark):
    rows = [("a", "x", 0), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0), ("c", "x", 0),
            ("c", "z", 0)]
    with pytest.raises(KCoreLimitError):
        k_core(frame(spark, rows), 2, 2, max_rounds=1)
    # a path sheds one end per round: many rounds, empty core
    path = [(f"u{k:02d}", f"i{k + d:02d}", 0) for k in range(40) for d in (0, 1)]
    res = k_core(frame(spark, path), 2, 2)
    assert res.counts[-1] == 0 and res.rounds > 12
    short = frame(spark, path[:12])
    assert k_core(short, 2, 2, scan_rows=0).counts == k_core(short, 2, 2).counts
    with pytest.raises(KCoreLimitError):
        k_core(frame(spark, rows), 2, 2, max_rounds=1, scan_rows=0)


def test_k_core_index_spreads_a_hot_key(spark):
    """An item with a third of all rows is dealt to many tasks of its bucket."""
    rows = [(f"u{k:03d}", "hot", 0) for k in range(300)]
    rows += [(f"u{k:03d}", f"i{(k + d) % 300:03d}", 0) for k in range(300) for d in (0, 1)]
    rows += [("lone", "i000", 0)]
    res = k_core(frame(spark, rows), 2, 2, scan_rows=0, rows_per_bucket=50)
    assert res.counts == [901, 900, 900] and res.interactions.count() == 900
    from fernrec.operators import kcore
    side = kcore._Side("item_id", "user_id", 2)
    df = frame(spark, rows)
    side.add_counts(df.groupBy("item_id").count().withColumnRenamed("count", "_n"))
    side.build_index(df, len(rows), 50)
    files = {r.f for r in side.rows.filter("item_id = 'hot'").selectExpr(
        "input_file_name() AS f").collect()}
    assert len(files) >= 4


def test_k_core_many_dying_keys_are_met_where_they_are_read(spark, monkeypatch):
    """Beyond MAX_SCAN_ROWS rounds use the index whatever the partitions; keys too many
    for a broadcast go by their bits (with false hits) and give the same core."""
    from fernrec.operators import kcore
    rows = [(f"u{k:03d}", f"i{k + d:03d}", k) for k in range(9) for d in (0, 1)]
    rows += [(f"r{k:02d}", f"j{(k + d) % 12:02d}", k) for k in range(12) for d in (0, 1)]
    want = k_core(frame(spark, rows), 2, 2)
    assert not want.buckets_read
    monkeypatch.setattr(kcore, "MAX_SCAN_ROWS", 20)
    for keys, slots in ((0, 64), (0, 1 << 24)):
        monkeypatch.setattr(kcore, "_BROADCAST_KEYS", keys)
        monkeypatch.setattr(kcore, "_SLOTS", slots)
        got = k_core(frame(spark, rows), 2, 2)
        assert got.buckets_read and got.counts == want.counts
        assert sorted(map(tuple, got.interactions.collect())) == sorted(
            map(tuple, want.interactions.collect()))


def test_k_core_counts_stay_where_they_are(spark):
    """The first counts are bucketed by their key: grouping by it moves nothing."""
    from fernrec.operators import kcore
    side = kcore._Side("item_id", "user_id", 2)
    df = frame(spark, [(f"u{k}", f"i{k % 7}", 0) for k in range(50)])
    side.add_counts(df.groupBy("item_id").count().withColumnRenamed("count", "_n"))
    plan = side.counts[0].groupBy("item_id").max("_n")._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()
    side.release()


def brute_k_core(rows, ku, ki):
    cur = list(rows)
    while True:
        uc = Counter(u for u, _, _ in cur)
        step = [r for r in cur if uc[r[0]] >= ku]
        ic = Counter(i for _, i, _ in step)
        step = [r for r in step if ic[r[1]] >= ki]
        if len(step) == len(cur):
            return step
        cur = step


@settings(max_examples=8, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 9)), min_size=0, max_size=60),
       st.integers(1, 4), st.integers(1, 4))
def test_k_core_matches_brute_force(spark, pairs, ku, ki):
    rows = [(f"u{u}", f"i{i}", 0) for u, i in sorted(pairs)]
    if not rows:
        return
    res = k_core(frame(spark, rows), ku, ki)
    indexed = k_core(frame(spark, rows), ku, ki, scan_rows=0, rows_per_bucket=5)
    assert indexed.counts == res.counts
    assert sorted(map(tuple, indexed.interactions.collect())) == sorted(
        map(tuple, res.interactions.collect()))
    got = sorted((r.user_id, r.item_id) for r in res.interactions.collect())
    assert got == sorted((u, i) for u, i, _ in brute_k_core(rows, ku, ki))
    # the result is a fixpoint: every user/item keeps the minimum degree
    assert all(c >= ku for c in Counter(u for u, _ in got).values())
    assert all(c >= ki for c in Counter(i for _, i in got).values())


def test_dense_index_golden(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "10", "é", "9", "Z", "a"]], "id string")
    got = {r.id: r.idx for r in dense_index(df, "id", "idx", num_partitions=3).collect()}
    assert got == {"10": 0, "9": 1, "Z": 2, "a": 3, "é": 4}


def test_dense_index_many_partitions(spark):
    ids = [f"k{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in ids], "id string").repartition(7)
    got = dense_index(df, "id", "idx", num_partitions=11).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(3000))
    assert [r.id for r in got] == sorted(ids)


def split(spark, events):
    df = spark.createDataFrame([(0, i, t) for i, t in events],
                               "user_idx bigint, item_idx bigint, ts bigint")
    sp = leave_one_out(df)
    train = sorted(r.item_idx for r in sp.train.collect())
    test = sp.test.collect()[0]
    return train, test.test_item_idx, test.n_train


@pytest.mark.parametrize("scale", [1, 1 << 57])
def test_split_golden(spark, scale):
    """scale 1: packed (ts, item) long; 2^57: ranges too wide, struct max."""
    def s(events):
        return split(spark, [(i, t * scale) for i, t in events])
    assert s([(4, 10), (2, 30), (7, 20)]) == ([4, 7], 2, 2)
    assert s([(4, 30), (2, 30), (7, 20)]) == ([2, 7], 4, 2)
    assert s([(5, 1)]) == ([], 5, 0)


def test_split_reads_its_input_once(spark, monkeypatch):
    """The index steps get a written table, and the held-out pairs are hashed."""
    from conftest import SF001
    from fernrec.plans import catalog
    seen, index = [], catalog.prep_ops.index_interactions

    def spy(interactions, *args):
        seen.append(getattr(interactions, "_scratch", (None, None))[0])
        return index(interactions, *args)
    monkeypatch.setattr(catalog.prep_ops, "index_interactions", spy)
    monkeypatch.setattr(catalog, "_cache", {})
    sp = catalog._ol_split(spark, SF001)
    assert seen and seen[0]
    assert sp.train.count() + sp.test.count() == catalog.ol_dedup(spark, SF001).count()
    assert "strategy=shuffle_hash" in sp.train._jdf.queryExecution().optimizedPlan().toString()


def test_weights_golden(spark):
    train = spark.createDataFrame([(u, 0) for u in range(4)] + [(9, 1)],
                                  "user_idx bigint, item_idx bigint")
    items = spark.createDataFrame([(0,), (1,), (2,)], "item_idx bigint")
    for alpha, expected in ((0.5, [6.666667, 3.333333, 0.0]), (0.0, [5.0, 5.0, 0.0])):
        w = all_item_weights(items, item_weights(train, 10.0, alpha)).orderBy("item_idx")
        assert [round(r.c, 6) for r in w.collect()] == expected
    empty = train.limit(0)
    w = all_item_weights(items, item_weights(empty, 10.0, 0.5))
    assert [r.c for r in w.collect()] == [0.0, 0.0, 0.0]


# Round counts measured on the driver tables (FIXTURES.md §2).

def test_k_core_rounds_on_order_lines(spark):
    from conftest import SF01
    from fernrec.sources.tables import order_line_interactions
    dd = dedup_latest(order_line_interactions(spark, SF01))
    want = [59391, 51353, 48385, 47189, 46773, 46708, 46708]
    assert k_core(dd, 23, 23).counts == want
    # the index: later rounds read fewer buckets, down to those of the last dying keys
    indexed = k_core(dd, 23, 23, scan_rows=0, rows_per_bucket=1000)
    assert indexed.counts == want and indexed.interactions.count() == want[-1]
    assert {r["user_id"] for r in indexed.interactions.collect()} == {
        r["user_id"] for r in k_core(dd, 23, 23).interactions.collect()}
    share = [read / of for _, read, of in indexed.buckets_read]
    assert all(of == 52 for *_, of in indexed.buckets_read)
    assert share[0] > 0.6 and share[-1] <= 0.2
    collapse = k_core(dd, 24, 24)
    assert collapse.counts[:3] == [59391, 47942, 41628] and collapse.counts[-1] == 0
    with pytest.raises(KCoreLimitError):
        k_core(dd, 24, 24, max_rounds=2)


def test_k_core_rounds_on_events(spark):
    from conftest import SF01, SF001
    from fernrec.sources.tables import events_interactions
    ev = dedup_latest(events_interactions(spark, SF01))
    assert k_core(ev, 40, 30).counts == [7310, 7155, 7155]
    small = dedup_latest(events_interactions(spark, SF001))
    assert k_core(small, 10, 10).counts == [739, 83, 0, 0]


def test_smoke_mode_reads_first_records(spark):
    import os
    import tempfile
    from fernrec.config import RuntimeConfig
    from fernrec.plans.end_to_end import load_review_text
    d = tempfile.mkdtemp(prefix="fernrec-smoke-")
    recs = [f"product/productId: I{i}\nreview/userId: U{i}\nreview/time: {i}" for i in range(20)]
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("\n\n".join(recs) + "\n")
    smoke = load_review_text(spark, d, RuntimeConfig(mode="smoke", smoke_records=5))
    assert sorted(r.ts for r in smoke.collect()) == [0, 1, 2, 3, 4]
    assert load_review_text(spark, d, RuntimeConfig()).count() == 20


def test_first_n_paths_agree(spark):
    """Top-n merge and distributed rank give the same first n rows."""
    from pyspark.sql import functions as F
    from fernrec.operators import prepare as P
    df = spark.range(0, 5000).select(F.md5(F.col("id").cast("string")).alias("k"),
                                     "id").repartition(6)
    merged = [tuple(r) for r in P.first_n(df, ["k", "id"], 300).orderBy("pos").collect()]
    saved, P.TOP_N_MERGE_LIMIT = P.TOP_N_MERGE_LIMIT, 10
    try:
        ranked = [tuple(r) for r in P.first_n(df, ["k", "id"], 300).orderBy("pos").collect()]
    finally:
        P.TOP_N_MERGE_LIMIT = saved
    assert merged == ranked and [r[2] for r in merged] == list(range(300))


def test_interactions_from_table(spark):
    import datetime
    from fernrec.sources.tables import interactions_from_table
    ints = spark.createDataFrame([(1, 10, 5), (2, None, 6), (3, 11, None), (None, 12, 7)],
                                 "u bigint, i bigint, t bigint")
    got = sorted(tuple(r) for r in interactions_from_table(ints, "u", "i", "t").collect())
    assert got == [("1", "10", 5)]
    stamps = spark.createDataFrame(
        [(1, 2, datetime.datetime(1970, 1, 1, 0, 0, 1)), (3, 4, datetime.datetime(2024, 1, 1))],
        "u bigint, i bigint, t timestamp_ntz")
    got = sorted(tuple(r) for r in interactions_from_table(stamps, "u", "i", "t").collect())
    assert got == [("1", "2", 1_000_000), ("3", "4", 1_704_067_200_000_000)]


@pytest.mark.parametrize("scale", [1, 1 << 57])
def test_split_negative_times(spark, scale):
    """Negative timestamps are valid; the packed key is offset by the minimum."""
    events = [(4, -30 * scale), (2, -10 * scale), (7, -20 * scale)]
    assert split(spark, events) == ([4, 7], 2, 2)
    assert split(spark, [(3, -5), (9, -5)]) == ([3], 9, 1)
