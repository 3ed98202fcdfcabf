"""Operators 3 and 7: held-out accuracy, and figures against brute force."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fernrec.llm.language_id import fit, identify_languages, letters_of, ngram_places, presence
from fernrec.llm.quality_rules import quality_rules

DOCS = "doc_id bigint, text string, lang string"
SF01 = "/root/testdata/sf0.01/documents.parquet"


def test_languages_held_out(spark):
    docs = spark.read.parquet(SF01).select("doc_id", "text", "lang")
    odd = [(90001, None, "en"), (90002, "", None), (90003, "12 34 !?", "de"),
           (None, "the and of that", "en")]
    rows = identify_languages(docs.unionByName(spark.createDataFrame(odd, DOCS)),
                              landmarks=48, fit_rows=600).collect()
    assert len(rows) == 1004
    by_id = {r.doc_id: r for r in rows}
    for k in (90001, 90002, 90003):
        assert by_id[k].lang_pred == "und" and by_id[k].score == 0
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
               for r in rows if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 150
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_little(spark):
    empty = spark.createDataFrame([], DOCS)
    assert identify_languages(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None)], DOCS)
    assert [r.lang_pred for r in identify_languages(unlabelled).collect()] == ["und"]
    assert letters_of("«12»") == b"" and letters_of("Ñ1 a") == "ñ  a".encode()


def test_kernel_and_ridge_against_direct_forms():
    rng = random.Random(1)
    alphabets = {"a": "abcde ", "b": "defgh ", "c": "xyzab "}
    labels = np.array([rng.choice("abc") for _ in range(60)])
    texts = ["".join(rng.choices(alphabets[x], k=rng.randint(3, 60))).encode() for x in labels]

    def place(gram):
        return ((int.from_bytes(gram, "big") + len(gram)) * 2654435761 % 2**32) >> 17

    padded = [b" " + raw + b" " for raw in texts]
    placed = [{place(raw[k:k + n]) for n in (2, 3, 4) for k in range(len(raw) - n + 1)}
              for raw in padded]
    for raw, want in zip(texts, placed):
        assert set(ngram_places(raw).tolist()) == want
    kernel = np.array([[len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for b in placed]
                       for a in placed])
    rows = presence(texts)
    assert np.allclose(rows @ rows.T, kernel, atol=1e-5)
    # every text a landmark: kernel ridge regression itself, here by its weighted
    # least squares over the kernel's own feature space
    weights, constants = fit(kernel, kernel, labels, ["a", "b", "c"], 1e-2)
    got = kernel @ weights + constants
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values.max()
    space = vectors[:, keep] * np.sqrt(values[keep])
    space = space - space.mean(axis=0)
    w = np.array([1 / (labels == x).sum() for x in labels])
    w = w / w.sum() * len(labels)
    gram = space.T @ np.diag(w) @ space
    ridge = 1e-2 * np.trace(gram) / len(gram)
    for k, lang in enumerate("abc"):
        y = np.where(labels == lang, 1.0, -1.0)
        y0 = (w * y).sum() / w.sum()
        solved = np.linalg.lstsq(
            np.vstack([np.sqrt(w)[:, None] * space, np.sqrt(ridge) * np.eye(len(gram))]),
            np.concatenate([np.sqrt(w) * (y - y0), np.zeros(len(gram))]), rcond=None)[0]
        assert np.allclose(got[:, k], space @ solved + y0, atol=1e-6)


def test_many_languages_and_copies(spark):
    rng = random.Random(2)
    many = [(k, "some text here", f"l{k}") for k in range(40)]
    with pytest.raises(ValueError, match="languages"):
        identify_languages(spark.createDataFrame(many, DOCS), landmarks=20).collect()
    letters = {"x": "abcdefg ", "y": "mnopqrs "}
    rows = [(k, "".join(rng.choices(letters["xy"[k % 2]], k=40)), "xy"[k % 2]) for k in range(200)]
    copies = [rows[0]] * 4000  # one row, most of the table
    got = identify_languages(spark.createDataFrame(rows + copies, DOCS), landmarks=16,
                             fit_rows=100).collect()
    assert len(got) == 4200
    truth = {k: lang for k, _, lang in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(got)


def base_figures(text):
    words = (text or "").encode().split()
    hit = set()
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    for k, w in enumerate(windows):
        if seen[w] > 1:
            hit |= {k, k + 1, k + 2}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup,
            len(hit), n < 50 or 100 * len(hit) > 50 * n)


def test_quality(spark):
    rng = random.Random(0)
    plain = "the of and in that he was for it with as his on be at by".split()
    docs = []
    for k in range(400):
        n = rng.randint(60, 300)
        words = ["".join(rng.choices(plain, k=rng.randint(1, 3))) for _ in range(n)]
        if k % 20 == 0:
            words = [w.upper() + "!!%%" for w in words]
        elif k % 20 == 1:
            words = ["☃𓀀ꙮ" for _ in range(60)]
        docs.append((k, "\n".join(" ".join(words[i:i + 15]) for i in range(0, n, 15)),
                     "en" if k % 7 else None))
    docs += [(1000, None, "en"), (1001, "", None), (None, docs[5][1], "en"),
             (5, docs[5][1], "en"), (1002, "a b c a b c é\x85 x\n\na b c a b c é\x85 x", "xx")]
    rows = quality_rules(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    exp = Counter((d, *base_figures(t)) for d, t, _ in docs)
    assert exp == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                           r.n_repeat_words, r.base_failed) for r in rows)
    assert not any(r.kept for r in rows if r.base_failed)
    clean = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 20 > 1]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert not any(r.kept for r in rows if r.doc_id is not None and r.doc_id < 400
                   and r.doc_id % 20 == 0)
    assert quality_rules(spark.createDataFrame([], DOCS)).collect() == []


def test_bands_ignore_copies(spark):
    """One text as a third of all rows changes no other row's result, and does
    not make a class of its own."""
    rng = random.Random(1)
    plain = "the of and in that he was for it with as his on be at by".split()
    text = lambda n: " ".join(
        "".join(rng.choices(plain, k=rng.randint(1, 3))) for _ in range(n))
    docs = [(k, text(rng.randint(60, 110)), "en") for k in range(400)]
    alone = [(k, text(100), "xx") for k in range(900, 905)]
    copies = [(2000 + k, docs[7][1], "en") for k in range(200)]
    copies += [(3000 + k, alone[0][1], "xx") for k in range(60)]
    plain_run, hot_run = ({r.doc_id: (r.kept, r.reasons) for r in quality_rules(
        spark.createDataFrame(x, DOCS)).collect()} for x in (docs + alone, docs + alone + copies))
    assert sum(kept for kept, _ in plain_run.values()) > 390
    assert {k: hot_run[k] for k in plain_run} == plain_run
    assert all(hot_run[k] == plain_run[7] for k in hot_run if 2000 <= k < 3000)
