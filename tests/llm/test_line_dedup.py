"""Repeated lines against a scan over all pairs."""
import random

from fernrec.llm.line_dedup import (drop_repeated_lines, line_dedup, repeated_lines, run_length,
                                    within_one_edit)

SCHEMA = "doc_id bigint, text string"


def brute(rows, least=1, near=5):
    """{(doc_id, line_no, near)} to drop, of rows with distinct ids."""
    seen, out = [], set()
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for no, line in enumerate((text or "").split("\n")):
            words = line.encode().lower().split()
            if len(words) < least:
                continue
            if words in seen:
                out.add((doc, no, False))
                continue
            if len(words) >= near and any(len(s) >= near and within_one_edit(s, words)
                                          for s in seen):
                out.add((doc, no, True))
            seen.append(words)
    return out


def rows_of(seed=0, docs=40):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 16, 17, 18, 33]))]
            for _ in range(25)]
    out = []
    for k in range(docs):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(pool))
            for _ in range(min(rng.choice([0, 1, 1, 2]), len(words))):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                if kind == 0:
                    words[at] = f"x{rng.randrange(9)}"
                elif kind == 1:
                    words.insert(at, f"x{rng.randrange(9)}")
                else:
                    del words[at]
            lines.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
        out.append((k * 3 % docs * 5 + k // docs, "\n".join(lines)))
    return out


def test_run_length():
    import numpy as np
    n = np.arange(4, 3000)
    m = run_length(n)
    assert (m <= (n - 1) / 2).all() and (4 * m >= n - 1).all()


def test_against_brute_force(spark):
    for seed in (0, 1):
        rows = rows_of(seed) + [(900, None), (901, ""), (902, "\n\n"), (None, rows_of(seed)[3][1])]
        df = spark.createDataFrame(rows, SCHEMA)
        got = {(r.doc_id, r.line_no, r.near) for r in repeated_lines(df).collect()}
        assert got == brute(rows)


def test_figures_and_texts(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"{line}\nshort\n{line.upper()}"), (2, f"{line} eleven\nown words of this text here"),
            (3, line), (4, None), (5, ""), (2, "other text of the same id here"), (3, line)]
    df = spark.createDataFrame([(*r, 7, "t") for r in rows], SCHEMA + ", line_no int, t string")
    got = sorted(map(tuple, line_dedup(df).collect()))
    assert got == [(1, 3, 1, 0), (2, 1, 0, 0), (2, 2, 0, 1), (3, 1, 1, 0), (3, 1, 1, 0),
                   (4, 0, 0, 0), (5, 1, 0, 0)]
    left = drop_repeated_lines(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text or "", r.t) for r in left.collect()) == [
        (1, f"{line}\nshort", "t"), (2, "other text of the same id here", "t"),
        (2, "own words of this text here", "t"), (4, "", "t"), (5, "", "t")]


def test_common_line_and_empty(spark):
    line = " ".join(f"c{k}" for k in range(12))
    df = spark.createDataFrame([(k, f"{line}\n{line} {k}") for k in range(300)], SCHEMA)
    out = line_dedup(df).collect()
    assert sum(r.n_repeated for r in out) == 299 and sum(r.n_near for r in out) == 300
    assert line_dedup(df.limit(0)).collect() == []
