"""Operator 11 against every piece measured with every entry."""
import hashlib
import math

import numpy as np
import pytest

SCHEMA = "label int, vec_id bigint, key string, embedding array<float>"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, label, vector) -> (sorted result rows, codebook digest)."""
    kept = [(i, l, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, l, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], ""
    d = len(kept[0][2]) // parts
    pieces = [[r[2][p * d:(p + 1) * d] for r in kept] for p in range(parts)]
    books = [[list(x) for x in pieces[p][:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in pieces[p]:
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(pieces[p][n], books[p]) for p in range(parts)] for n in range(len(kept))]
    errors = [sum(f[0] for f in row) for row in found]
    by_label = {}
    for (_, l, _), e in zip(kept, errors):
        by_label[l] = by_label.get(l, 0) + e
    text = ",".join(str(x) for book in books for e in book for x in e)
    out = [(i, "".join(f"{f[1]:02x}" for f in row), e, by_label[l])
           for (i, l, _), row, e in zip(kept, found, errors)]
    return sorted(out, key=str), hashlib.sha256(text.encode()).hexdigest()


def made(spark, rows, **options):
    from fernrec.llm.vector_codes import compress_vectors
    df = spark.createDataFrame([(l, i, "x", v) for i, l, v in rows], SCHEMA).repartition(3)
    got = compress_vectors(df, **options).collect()
    return sorted((tuple(r)[:4] for r in got), key=str), {r.codebooks_sha256 for r in got}


def clustered(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return (centres[rng.integers(0, 7, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def test_against_brute_force(spark):
    vectors = clustered(400, 16, 1)
    rows = [(k, k % 5 if k % 7 else None, list(map(float, v))) for k, v in enumerate(vectors)]
    rows += [(1000, 1, None), (1001, 1, [None] * 16), (1002, 2, [float("nan")] + [0.0] * 15),
             (1003, 2, [float("-inf")] + [0.0] * 15), (None, 3, rows[0][2]), (5, 4, rows[9][2]),
             (7, 1, rows[7][2]), (7, 1, rows[7][2])]
    want, digest = brute(rows)
    for options in ({}, {"block": 4, "group_values": 64 * 16}):
        got, digests = made(spark, rows, **options)
        assert got == want and digests == {digest}


def test_ties_copies_and_few_rows(spark):
    """A third of all rows is one vector; entries start equal, ties go down."""
    vectors = clustered(60, 8, 2, spread=1.0).round(1)
    rows = [(k, 0, list(map(float, vectors[0 if k % 3 == 0 else k]))) for k in range(60)]
    want, digest = brute(rows)
    got, digests = made(spark, rows, block=4)
    assert got == want and digests == {digest}
    want, digest = brute(rows[:5])
    got, digests = made(spark, rows[:5])
    assert got == want and digests == {digest}
    assert made(spark, rows[:0]) == ([], set())


def test_shortlists_decide_blocks(spark):
    """On clustered pieces most blocks keep one entry, and never lose the nearest."""
    from fernrec.llm.vector_codes import Blocks
    points = np.floor(4096 * clustered(4000, 8, 3)).astype(np.int64)
    blocks = Blocks.build(points, 32)
    entries = np.unique(np.floor(4096 * clustered(4000, 8, 3, spread=0)).astype(np.int64), axis=0)
    listed = blocks.shortlists(entries)
    assert len(entries) == 7 and (listed.sum(axis=1) == 1).mean() > 0.9
    dist = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    codes, best = blocks.codes(entries)
    assert (codes == dist.argmin(axis=1)).all() and (best == dist.min(axis=1)).all()
    counts, sums = blocks.sums_by_entry(entries)
    assert (counts == np.bincount(codes, minlength=7)).all()
    assert all((sums[k] == points[codes == k].sum(axis=0)).all() for k in range(7))


def test_hilbert_neighbours():
    """Consecutive cells of the curve differ by one step; every cell once."""
    from fernrec.llm.vector_codes import hilbert_keys
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_unlike_vectors_are_an_error(spark):
    for bad in ([1.0] * 16, [1.0] * 12, [3e38] * 8):
        with pytest.raises(Exception, match="unlike lengths|equal parts|too large"):
            made(spark, [(1, 0, [1.0] * 8 if len(bad) == 16 else bad), (2, 0, bad)])
