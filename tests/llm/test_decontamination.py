"""Benchmark hits against a direct scan."""
import hashlib
import random
import re
import time

from fernrec.llm.decontamination import benchmark_hits, contamination, drop_contaminated

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[k:k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                got = grams.get(tuple(w[k:k + size]))
                if got is not None:
                    hit |= set(range(k, k + size))
                    found |= got
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len({i for i in found if i is not None}),
                    hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(0)
    vocab = [f"w{k}" for k in range(9)] + ["É", "日本", "A", "it's"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 12, 20])))) for k in range(8)]
    items += [(90, None), (91, " .,"), (92, items[2][1]), (93, "Solo")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 40)))
        if k % 3 == 0:
            text += ", " + items[rng.randrange(8)][1].upper() + "! " + text
        docs.append((k, text))
    docs += [(100, None), (101, ""), (None, items[0][1]), (5, docs[5][1]), (5, "solo solo"),
             (102, (items[3][1] + " x ") * 300)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    for limit in (64 << 20, 0):  # broadcast, and the shuffled join
        got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS),
                            broadcast_bytes=limit)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_spans_and_dropping(spark):
    items = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(12)))], ITEMS)
    text = "x y " + " ".join(f"b{k}" for k in range(12)) + " z " + " ".join(f"b{k}" for k in range(9))
    docs = spark.createDataFrame([(1, text, 7, "q"), (2, "clean", 8, "r"), (3, None, 9, "s")],
                                 "doc_id bigint, text string, h int, items string")
    row = benchmark_hits(docs, items).filter("doc_id = 1").first()
    assert [(s.a, s.b) for s in row.spans] == [(2, 13)]
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert drop_contaminated(docs, items, max_share=0.9).count() == 3


def test_empty_tables(spark):
    docs, items = case()
    none = spark.createDataFrame([], ITEMS)
    got = contamination(spark.createDataFrame(docs, DOCS), none)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, [])
    assert contamination(spark.createDataFrame([], DOCS), none).collect() == []


def test_shuffled_join_is_linear_in_the_text(spark):
    """Beyond the broadcast limit nothing but hash and place is shuffled per window."""
    item = " ".join(f"b{k}" for k in range(10))
    items = spark.createDataFrame([(1, item)], ITEMS)
    body = " ".join(f"v{k}" for k in range(32000))
    docs = spark.createDataFrame([(k, f"{body} {item}") for k in range(4)] + [(None, None)] * 200, DOCS)
    start = time.perf_counter()
    got = contamination(docs, items, broadcast_bytes=0).collect()
    assert time.perf_counter() - start < 60
    assert sorted((r.n_words, r.n_hit) for r in got) == [(0, 0)] * 200 + [(32010, 10)] * 4
