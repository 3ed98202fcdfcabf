"""Golden cases of the review-text parser and record reader (FIXTURES §3)."""

import os
import tempfile

import pytest

from fernrec.sources.text import load_interactions, parse_records, sample_first_records

P, U, T = "product/productId: ", "review/userId: ", "review/time: "


def parse(spark, blocks):
    df = spark.createDataFrame([(b,) for b in blocks], "value string")
    return [tuple(r) for r in parse_records(df).collect()]


CASES = [
    (f"{P}B1\n{U}U1\n{T}5", [("U1", "B1", 5)]),
    (f"review/summary: x\n{T}5\nother\n{U}U1\n{P}B1", [("U1", "B1", 5)]),
    (f"{P} B1 \n{U}\tU1 \n{T} 5 ", [("U1", "B1", 5)]),
    (f"product/productId:B1\n{U}U1\n{T}5", []),
    (f" {P}B1\n{U}U1\n{T}5", []),
    (f"{P}B1\n{U}U1\n{U}U2\n{T}5", [("U2", "B1", 5)]),
    (f"{P}B1\n{U}U1\n{U}\n{T}5", []),
    (f"{P}B1\n{U}U1\n{T}abc", []),
    (f"{P}B1\n{U}U1\n{T}", []),
    (f"{P}B1\n{U}U1\n{T}12.5", []),
    (f"{P}B1\n{U}U1\n{T}abc\n{T}5", []),
    (f"{P}B1\n{U}U1\n{T}5\n{T}7", [("U1", "B1", 7)]),
    (f"{P}B1\n{U}U1\n{T}0", [("U1", "B1", 0)]),
    (f"{P}B1\n{U}U1\n{T}-3", [("U1", "B1", -3)]),
    (f"{P}B1\n{U}U1\n{T}+5", [("U1", "B1", 5)]),
    (f"{P}B1\n{U}U1", []),
    (f"{P}B1\n{T}5", []),
    (f"{U}U1\n{T}5", []),
    ("", []),
]


@pytest.mark.parametrize("block,expected", CASES)
def test_parse_golden(spark, block, expected):
    assert parse(spark, [block]) == expected


@pytest.mark.parametrize("sep", ["\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", " ",
                                 " ", "\r", "\r\n"])
def test_line_breaks(spark, sep):
    assert parse(spark, [sep.join([f"{P}B1", f"{U}U1", f"{T}5"])]) == [("U1", "B1", 5)]


def _write(text):
    d = tempfile.mkdtemp(prefix="fernrec-test-")
    with open(os.path.join(d, "part.txt"), "w", encoding="utf-8") as f:
        f.write(text)
    return d


def test_record_separation(spark):
    a = f"{P}A\n{U}U1\n{T}1"
    b = f"{P}B\n{U}U2\n{T}2"
    for text, n in ((a + "\n\n" + b, 2), (a + "\n\n\n" + b, 2), (a + "\n\n\n\n" + b, 2)):
        got = sorted(tuple(r) for r in load_interactions(spark, _write(text)).collect())
        assert got == [("U1", "A", 1), ("U2", "B", 2)][:n]
    # a CRLF file is one record (the delimiter is exactly two line feeds): last wins
    crlf = (a + "\r\n\r\n" + b).replace("\n", "\r\n").replace("\r\r\n", "\r\n")
    got = [tuple(r) for r in load_interactions(spark, _write(crlf)).collect()]
    assert got == [("U2", "B", 2)]


def test_sample_first_records(spark):
    recs = [f"{P}I{i}\n{U}U{i}\n{T}{i}" for i in range(10)]
    text = recs[0] + "\n\n" + recs[1] + "\n  \n" + recs[2] + "\n\n\n\n" + "\n\n".join(recs[3:])
    d = _write(text)
    got = sample_first_records(spark, d, 4).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 1, 2, 3]
    assert [r["value"].split("\n")[0] for r in got] == [f"{P}I{i}" for i in range(4)]
    assert sample_first_records(spark, d, 100).count() == 10


# Property: random records against the format's specification.
# Time values avoid the two accepted deviations (digit separators and values
# beyond 64 bits, which the integer cast rejects).

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
_PAD = ["", " ", "\t", " ", " ", "\x1f"]
_TIMES = ["5", "-3", "+7", "0", "abc", "", "12.5", "42 ", " 9"]
_IDS = ["A", "B1", "x y", "", "é", "Q\x1fR"]


def _spec(block):
    fields = {}
    for line in block.splitlines():
        for name, prefix in (("item", P), ("user", U), ("time", T)):
            if line.startswith(prefix):
                value = line[len(prefix):].strip()
                if name == "time":
                    try:
                        value = int(value)
                    except ValueError:
                        return None
                fields[name] = value
    if not fields.get("user") or not fields.get("item") or "time" not in fields:
        return None
    return fields["user"], fields["item"], fields["time"]


_line = st.one_of(
    st.tuples(st.sampled_from([P, U, " " + U, "review/userid: "]), st.sampled_from(_PAD),
              st.sampled_from(_IDS), st.sampled_from(_PAD)).map("".join),
    st.tuples(st.just(T), st.sampled_from(_PAD), st.sampled_from(_TIMES)).map("".join),
    st.sampled_from(["review/summary: ok", "", "review/score: 5.0"]))
_block = st.lists(st.tuples(_line, st.sampled_from(_BREAKS)), max_size=7).map(
    lambda parts: "".join(a + b for a, b in parts))


@settings(max_examples=int(__import__("os").environ.get("PARSE_EXAMPLES", "10")), deadline=None)
@given(st.lists(_block, min_size=1, max_size=60))
def test_parse_matches_spec(spark, blocks):
    got = parse(spark, blocks)
    exp = [r for r in map(_spec, blocks) if r is not None]
    assert sorted(got) == sorted(exp)


def test_sample_first_records_across_files(spark):
    """Files are taken in name order, in growing batches, until n records."""
    d = tempfile.mkdtemp(prefix="fernrec-multi-")
    for f, base in (("b.txt", 3), ("a.txt", 0), ("d.txt", 9), ("c.txt", 6)):
        with open(os.path.join(d, f), "w", encoding="utf-8") as fh:
            fh.write("\n\n".join(f"{P}I{base + i}\n{U}U\n{T}{base + i}" for i in range(3)))
    for n, expected in ((2, [0, 1]), (5, [0, 1, 2, 3, 4]), (10, list(range(10))),
                        (100, list(range(12))), (0, [])):
        got = parse_records(sample_first_records(spark, d, n), keep=("pos",)).orderBy("pos")
        assert [r.ts for r in got.collect()] == expected
