"""Near-duplicates against brute force over all pairs."""
import numpy as np
import pytest

from fernrec.llm.near_dedup import keep_one_of_each, near_duplicates, shingle_set, super_minhash

SCHEMA = "doc_id bigint, text string"


def brute(rows, shingle, percent):
    """{(doc_id, text): (n_shingles, component, kept)} over distinct rows."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingle_set(t or "", shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    near = {(a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1:]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {rows[k]: (len(sets[k]), rows[find(k)][0], find(k) == k) for k in range(len(rows))}


def same(spark, rows, shingle=4, percent=80):
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(df, shingle=shingle, percent=percent).collect()
    assert len(got) == len(rows)
    exp = brute(rows, shingle, percent)
    by_id = {k[0]: v for k, v in exp.items()}
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == by_id[r.doc_id], r


def edited(rng, words, k):
    words = list(words)
    for at in rng.choice(len(words), k, replace=False):
        words[at] = f"e{rng.integers(1 << 30)}"
    return " ".join(words)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a = np.concatenate([shared, rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    b = np.concatenate([shared, rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    sig = super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2, 1000)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.06
    again = super_minhash(np.concatenate([b, b, a[::-1]]), np.repeat([0, 0, 1], 400), 2, 1000)
    assert (again[1] == sig[0]).all() and (again[0] == sig[1]).all()
    few = super_minhash(a[:3], np.zeros(3, np.int64), 1, 64)
    assert np.isfinite(few).all() and len({int(x) for x in few[0]}) > 20


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, rng.integers(30, 200))]
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows) * 3 % 997, edited(rng, base, int(rng.integers(0, 6)))))
    # a chain: each next to its neighbours only
    base = [f"c{k}" for k in range(120)]
    for k in range(0, 30, 2):
        rows.append((2000 + k, " ".join(base[k:k + 90])))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "One  TWO"),
             (3005, "one"), (None, "zz yy xx ww vv")]
    rows.append(rows[0])
    same(spark, rows)
    same(spark, rows, shingle=5, percent=70)


def test_large_group_without_centre(spark):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in range(150)]
    rows = [(k, edited(rng, base, int(rng.integers(2, 5)))) for k in range(150)]
    same(spark, rows)


def test_sample_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same(spark, [tuple(r) for r in docs.collect()])


def test_keep_and_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, text, 5, "x", 1), (2, text + " z", 6, "y", 2), (3, "a", 7, "z", 3)],
                               "doc_id bigint, text string, n_shingles int, kept string, bands int")
    assert sorted(r.doc_id for r in keep_one_of_each(df).collect()) == [1, 3]
    assert keep_one_of_each(df).columns == df.columns


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, "")]])
def test_little(spark, rows):
    same(spark, rows) if rows else None
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == len(rows)


def test_repeated_ids_and_rows(spark):
    """``kept`` follows the ids; one of equal rows stays, whatever their share."""
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text + " z"), (2, "a b"), (2, "a b"), (3, None), (3, None)] + [(4, "hot row")] * 9
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows) and all(r.kept and r.component_id == r.doc_id for r in got)
    left = sorted(((r.doc_id, r.text) for r in keep_one_of_each(df).collect()), key=str)
    assert left == sorted([(1, text), (2, "a b"), (3, None), (4, "hot row")], key=str)
