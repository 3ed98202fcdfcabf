"""Segment search against brute force, and held-out accuracy."""
import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from fernrec.llm import toxicity
from fernrec.llm.toxicity import (drop_toxic, fit_logistic, karlin_lambda, maximal_segments,
                                  score_toxicity)


def all_scores(places, scores, drift, n):
    x = np.full(n, -drift)
    x[places] = scores
    return x


def brute_segments(x):
    """Maximal segments by their definition: split off the best, recurse."""
    best, at = 0.0, None
    for a in range(len(x)):
        for b in range(a, len(x)):
            s = x[a:b + 1].sum()
            if s > best + 1e-12:
                best, at = s, (a, b)
    if at is None:
        return []
    a, b = at
    right = [(c + b + 1, d + b + 1, s) for c, d, s in brute_segments(x[b + 1:])]
    return brute_segments(x[:a]) + [(a, b, best)] + right


def test_maximal_segments():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        places = np.sort(rng.choice(n, int(rng.integers(0, n + 1)), replace=False))
        scores = rng.normal(0.5, 2, len(places))
        got = maximal_segments(places, scores, 0.3)
        exp = brute_segments(all_scores(places, scores, 0.3, n))
        assert [g[:2] for g in got] == [e[:2] for e in exp]
        assert np.allclose([g[2] for g in got], [e[2] for e in exp])


def test_lambda_and_logistic():
    scores, shares = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    assert abs((shares * np.exp(karlin_lambda(scores, shares) * scores)).sum() - 1) < 1e-6
    x = np.array([0, 0, 0, 5, 6, 7.0])
    a, b = fit_logistic(x, (x > 1).astype(float), 0.01)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert (p[:3] < 0.5).all() and (p[3:] > 0.5).all()


def corpus(n=600):
    rng = random.Random(0)
    plain, bad = [f"w{k}" for k in range(300)], ["vile", "Scum!", "rotten"]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        words = rng.choices(plain, k=rng.randint(20, 80))
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((k, " ".join(words)))
        if k % 3 != 1:
            labels.append((k, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int"


def test_held_out(spark):
    docs, labels = corpus()
    docs += [(9000, None), (9001, ""), (None, "vile scum rotten vile"), (6, "again")]
    labels += [(4, None), (None, 1), (0, 0)]
    out = score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    rows = out.collect()
    assert len(rows) == len(docs)
    truth = {k: k % 6 == 0 for k in range(600)}
    wrong = [r for r in rows if r.doc_id in truth and r.doc_id != 6
             and r.predicted != truth[r.doc_id]]
    assert not wrong
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    odd = {r.doc_id: r for r in rows if r.doc_id in (None, 9000, 9001)}
    assert odd[None].predicted == 1 and odd[9000].predicted == odd[9001].predicted == 0
    assert odd[None].passages[0].first_word == 0 and odd[None].passages[0].last_word == 3


def test_dropping_and_little(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", score int, toxic string")
    left = drop_toxic(df, spark.createDataFrame(labels, LABELS))
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [k for k in range(300) if k % 6]
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in score_toxicity(df, none).collect()} == {0}
    assert score_toxicity(df.limit(0), none).collect() == []


def test_odds_do_not_shrink_as_the_corpus_grows(spark, monkeypatch):
    """A planted word in 40 % of the toxic and 2 % of the clean texts; every
    text also stands in the table a second time."""
    kept, real = [], toxicity._log_odds

    def spy(counts, totals, *rest):
        kept.append((counts, totals, real(counts, totals, *rest)))
        return kept[-1][2]

    monkeypatch.setattr(toxicity, "_log_odds", spy)
    vocabulary = [f"w{k}" for k in range(2000)]
    weights = [1 / (k + 1) for k in range(2000)]
    for n in (500, 5000):
        rng, docs, labels = random.Random(n), [], []
        for k in range(n):
            toxic, turn = k % 2, k // 2 % 50
            words = rng.choices(vocabulary, weights, k=60)
            words += ["planted"] if turn < (20 if toxic else 1) else []
            docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words))]
            labels += [(2 * k, toxic), (2 * k + 1, toxic)]
        score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS),
                       held_out_mod=1 << 30).collect()
        counts, _, found = kept[-1]
        bucket = F.pmod(F.xxhash64(F.lit(b"planted").cast("string")), F.lit(1 << toxicity.BITS))
        row = counts.filter(F.col("bucket") == bucket).first()
        assert (row.t, row.c) == (n // 2 * 20 // 50, n // 2 // 50)
        kept[-1] = found.filter(F.col("bucket") == bucket).first().score
    assert abs(kept[0] - kept[1]) < 0.05 and kept[1] > 2.5


def test_rows_go_one_by_one(spark):
    """A toxic text takes no other text of its id, or of no id, with it."""
    docs, labels = corpus(300)
    bad = next(t for d, t in docs if d % 6 == 0)
    clean = next(t for d, t in docs if d % 6)
    extra = [(None, bad), (None, clean), (5000, bad), (5000, clean), (5001, bad), (5001, bad)]
    left = drop_toxic(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, LABELS))
    rows = [tuple(r) for r in left.collect()]
    assert sorted((str(d), t) for d, t in rows if d is None or d >= 5000) == sorted(
        [("None", clean), ("5000", clean)])
