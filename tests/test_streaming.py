"""The streaming ingest appends exactly the parsed records of new files."""

import os
import tempfile

from fernrec.streaming import ingest_review_files

P, U, T = "product/productId: ", "review/userId: ", "review/time: "


def test_ingest_available_now(spark):
    src = tempfile.mkdtemp(prefix="fernrec-src-")
    out = tempfile.mkdtemp(prefix="fernrec-out-")
    ckpt = tempfile.mkdtemp(prefix="fernrec-ck-")
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write(f"{P}I1\n{U}U1\n{T}1\n\n{P}I2\n{U}U2\n{T}bad\n\n{P}I3\n{U}U3\n{T}3\n")
    q = ingest_review_files(spark, src, out, ckpt)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("U1", "I1", 1), ("U3", "I3", 3)]
    with open(os.path.join(src, "b.txt"), "w") as f:
        f.write(f"{P}I4\n{U}U4\n{T}4\n")
    q = ingest_review_files(spark, src, out, ckpt)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("U1", "I1", 1), ("U3", "I3", 3), ("U4", "I4", 4)]


def test_default_checkpoint_goes_on(spark):
    src = tempfile.mkdtemp(prefix="fernrec-src-")
    out = os.path.join(tempfile.mkdtemp(prefix="fernrec-out-"), "table")
    for k in (1, 2, 3):
        with open(os.path.join(src, f"{k}.txt"), "w") as f:
            f.write(f"{P}I{k}\n{U}U{k}\n{T}{k}\n")
        ingest_review_files(spark, src, out).awaitTermination(120)
        got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
        assert got == [(f"U{j}", f"I{j}", j) for j in range(1, k + 1)]
