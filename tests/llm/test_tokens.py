"""Operators 1 and 2 and the shared encoders against the libraries."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fernrec.llm.token_counts import count_tokens
from fernrec.llm.token_files import WaveletMatrix, build_file, token_digests
from fernrec.llm import tokens
from fernrec.llm.tokens import (PIECE_BPE, WORD_BPE, WordEncoder, encoder, load_tokenizer,
                                vocabulary_path)

SCHEMA = "doc_id bigint, text string"
ODD = [None, "", "  \n\t", "a<|endoftext|>b c<|startoftext|>", "é x́ ́a  ", "x\x85y z\x1cq",
       "İstanbul ΣΑΣ ﬁ", "don't 's '  's", "日本語 テキスト", "à̖b", "K Å ẞ",
       "x​y 　 z", "12 3a4", " ̸= ≠", "\x00a\x0bb"]


def library(text):
    return load_tokenizer(vocabulary_path(WORD_BPE)).encode(
        text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng = random.Random(1)
    tok = load_tokenizer(vocabulary_path(WORD_BPE))
    enc = encoder(vocabulary_path(WORD_BPE))
    signs = [chr(c) for c in range(33, 127)] + list("àÖßÿ÷×İſK")
    texts = [t for t in ODD if t] + [" ".join("".join(rng.choices(signs, k=rng.randint(1, 6)))
                                              for _ in range(50)) for _ in range(100)]
    found = enc.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        ids = found.ids[found.offsets[k]:found.offsets[k + 1]].tolist()
        assert ids == tok.encode(t, add_special_tokens=False).ids, t
    assert (enc.counts([t.encode() for t in texts]) == found.counts).all()


def test_memo_bound_changes_nothing():
    small = WordEncoder(vocabulary_path(WORD_BPE), memo_words=10, memo_bytes=100)
    texts = [f"word{k} other{k % 7} the end" .encode() for k in range(300)]
    for lo in range(0, 300, 20):
        part = texts[lo:lo + 20]
        assert (small.encode(part).ids == encoder(vocabulary_path(WORD_BPE)).encode(part).ids).all()


def test_piece_encoder_words():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECE_BPE))
    text = "The quick brown 日本 fox ☃ jumps"
    assert encoder(vocabulary_path(PIECE_BPE)).encode([text.encode()]).ids.tolist() == model.encode(text)


def long_rows():
    rng = random.Random(3)
    words = ["The", "of", "aé", "12", "日本語", "don't", "x" * 50]
    return [(1, "<|endoftext|> don't é x́ 12 a" * 400), (None, "hello  world " * 2000),
            (4, "x" * 9000), (4, "x" * 9000), (5, "  \n" * 5000),
            (6, " ".join(rng.choices(words, k=5000)))]


def test_counts_and_splices(spark):
    rows = [(k, t) for k, t in enumerate(ODD, 10)] + long_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = count_tokens(df, chunk_chars=4000, overlap_chars=200, limit=50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(
        (d, len((t or "").encode()), len(library(t))) for d, t in rows)
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)


def test_counts_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert count_tokens(empty).collect() == []
    named = spark.createDataFrame([(1, "a b", 5, "q")],
                                  "doc_id bigint, text string, n_tokens int, _k string")
    assert [tuple(r) for r in count_tokens(named).collect()] == [(1, 3, 2, False)]


@pytest.mark.parametrize("n,high", [(0, 1), (1, 1), (7, 3), (1500, 9), (5000, 49408), (2000, 1 << 17)])
def test_wavelet_matrix(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n).astype(np.uint32)
    ids[:n // 3] = 0
    matrix = WaveletMatrix(build_file(ids, np.array([n])))
    assert (matrix.ids() == ids).all() and matrix.counts.tolist() == [n]
    for place in rng.integers(0, max(n, 1), 40 if n else 0):
        value = int(ids[place])
        assert matrix.access(int(place)) == value
        assert matrix.rank(value, int(place)) == (ids[:place] == value).sum()
        where = np.nonzero(ids == value)[0]
        nth = int(rng.integers(0, len(where)))
        assert matrix.select(value, nth) == where[nth]
    assert matrix.rank(1 << 20, n) == 0
    for bad in (lambda: matrix.access(n), lambda: matrix.select(0, n)):
        with pytest.raises(IndexError):
            bad()


def test_files_round_trip(spark):
    rows = [(k * 7 % 31, f"text {k} " + "of the end. " * (k * 13 % 40)) for k in range(60)]
    rows += [(None, None), (3, None), (7, ""), (7, "")] + long_rows()
    got = token_digests(spark.createDataFrame(rows, SCHEMA), shard_tokens=500).collect()
    ids = [(d, library(t) + [2]) for d, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert token_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_memo_rows_are_the_pieces(monkeypatch):
    """Pieces as ``split`` gives them, ends and odd bytes included; equal rows
    for equal pieces; hashes that collide decide nothing."""
    enc = WordEncoder(vocabulary_path(WORD_BPE))
    texts = [b"", b"  ", b" a b\x0b\x0ca \r\n", "é x y a\x1cb".encode(), b"a" * 9000 + b" b", b"a b"]
    groups = list(enc.pieces(texts))
    assert len(groups) == 1 and groups[0][1].tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.split()]
    rows = groups[0][2].tolist()
    assert len(rows) == len(words) and len(set(zip(words, rows))) == len(set(words)) == len(set(rows))
    want = enc.encode(texts).ids.tolist()
    monkeypatch.setattr(tokens, "_POWERS", np.zeros_like(tokens._POWERS))  # every hash is the same
    alike = WordEncoder(vocabulary_path(WORD_BPE))
    assert [alike.encode(texts).ids.tolist() for _ in range(3)] == [want] * 3
    assert len(set(alike.hashes.tolist())) == 1


def test_memo_stays_within_its_bytes():
    rng = np.random.default_rng(5)
    small = WordEncoder(vocabulary_path(WORD_BPE), memo_words=4000, memo_bytes=150_000)
    whole = WordEncoder(vocabulary_path(WORD_BPE))
    for _ in range(30):
        text = b" ".join(b"w%d" % n for n in rng.zipf(1.3, 800).clip(0, 10 ** 9))
        assert (small.encode([text]).ids == whole.encode([text]).ids).all()
        assert small.memory() <= 150_000 + 60 * 800 and len(small.lens) <= 4800


def test_hot_id_is_spread(spark):
    """A third of all rows under one id, and copies of one row, fill many shards' tasks."""
    rows = [(7 if k % 3 else None, f"text {k} " * 5) for k in range(60)] + [(9, "same")] * 60
    rows += [(100 + k, f"other {k}") for k in range(60)]
    from fernrec.llm.token_files import read_token_digests, write_token_files
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    files = spark.read.parquet(write_token_files(docs, partitions=6))
    held = [r.n for r in files.selectExpr("part", "size(doc_ids) AS n").groupBy("part").sum("n")
            .withColumnRenamed("sum(n)", "n").collect()]
    assert len(held) >= 5 and max(held) <= 80
    got = sorted((r.start, r.doc_id) for r in read_token_digests(files).collect())
    ids = [d for _, d in got]
    assert len(got) == 180 and ids == sorted(ids, key=lambda d: (d is not None, d or 0))
