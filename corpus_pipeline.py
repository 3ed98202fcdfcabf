"""Corpus pipeline: documents -> clean, deduplicated, decontaminated, encoded.

``STAGES`` are (name, function) pairs applied in order. A function takes
(spark, docs, sf_dir) and returns a frame that is written as Parquet and read
back as the next one's ``docs``. All stages but the last keep the columns of
``documents``; every one works on all rows its predecessor kept.

1. toxicity        documents predicted toxic go (labels of sf_dir train it)
2. line_dedup      repeated lines are cut out (n_chars follows); documents left
                   empty go
3. near_dedup      of each group of near duplicates (5-word shingles, Jaccard
                   similarity of at least 0.8) the first document stays
4. decontaminate   documents with a benchmark window of 10 words go
5. encode          token ids and the decoded text of every document

An empty table, null texts and repeated rows pass through as the operators
define. SQL cannot express stages 1, 3 and 5, so there is no ORACLE_SQL; the
tests compare the pipeline with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernrec.llm.chunk_bpe import encode_documents
from fernrec.llm.common import read_table, written
from fernrec.llm.decontamination import drop_contaminated
from fernrec.llm.line_dedup import drop_repeated_lines
from fernrec.llm.near_dedup import keep_one_of_each
from fernrec.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids_sha256, decoded_sha256,
    ids (little-endian 32-bit), decoded."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
