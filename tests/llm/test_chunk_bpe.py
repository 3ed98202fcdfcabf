"""Chunked encoding against the library on whole texts."""
import hashlib
import random
from collections import Counter

import numpy as np

from fernrec.llm.chunk_bpe import chunk_cuts, encode_documents, gear_hash, layout
from fernrec.llm.tokens import WORD_BPE, load_tokenizer, vocabulary_path

SCHEMA = "doc_id bigint, text string"


def test_rolling_hash_sees_the_last_32_bytes():
    rng = np.random.default_rng(0)
    a, b, shared = (rng.integers(0, 256, k).astype(np.uint8) for k in (70, 45, 200))
    x, y = gear_hash(np.concatenate([a, shared])), gear_hash(np.concatenate([b, shared]))
    assert (x[70 + 31:] == y[45 + 31:]).all()
    cuts = chunk_cuts(rng.integers(0, 256, 100_000).astype(np.uint8))
    sizes = np.diff([0, *cuts, 100_000])
    assert sizes[:-1].min() >= 256 and sizes.max() <= 1 << 14 and 500 < sizes.mean() < 3000


def test_layout_covers_the_text():
    rng = random.Random(0)
    for text in (b"", b"x" * 50_000, b" " * 5000,
                 " ".join("".join(rng.choices("abcdé\n", k=rng.randint(1, 9)))
                          for _ in range(5000)).encode()):
        spans = layout(text)
        assert b"".join(text[a:b] for a, b, _ in spans) == text
        for (_, b, _), (c, _, _) in zip(spans, spans[1:]):
            assert b == c and (text[b - 1:b].isspace() or text[b:b + 1].isspace())


def expected(rows):
    tok = load_tokenizer(vocabulary_path(WORD_BPE))
    out = Counter()
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        text = tok.decode(ids, skip_special_tokens=False)
        out[doc, len(ids), hashlib.sha256(raw).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_whole_results(spark):
    rng = random.Random(1)
    words = ["The", "of", "aé", "12", "日本語", "don't", "x" * 50, "<|endoftext|>", "a<|endoftext|>b",
             "́e", "Ḱ", "\x85q", "tion,"]
    base = " ".join(rng.choices(words, k=3000))
    rows = [(k, base[k * 37:] + " ".join(rng.choices(words, k=40)) + base[:900 * k])
            for k in range(12)]
    rows += [(50, None), (51, ""), (None, base), (52, "y" * 40_000), (53, base), (53, base),
             (54, " \n\t" * 3000), (55, base + "y" * 9000 + base), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = encode_documents(df).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                   for r in got) == expected(rows)
    for r in got:
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256


def test_sample_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = encode_documents(docs.withColumn("t", docs.lang).withColumn("ids", docs.n_chars), full=False)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == expected(
        map(tuple, docs.select("doc_id", "text").collect()))


def test_empty(spark):
    assert encode_documents(spark.createDataFrame([], SCHEMA)).collect() == []
