"""The registered queries: SQL on DuckDB, the pipeline, empty and odd tables."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
SF01, SF001 = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def entry():
    import __spark_entry__ as E
    return E


def test_registered():
    from fernrec.llm.queries import ORACLE_SQL, QUERIES
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry().queries())
    assert set(ORACLE_SQL) <= set(entry().oracle_sql())


@pytest.mark.parametrize("name", ["op4_decontamination", "op8_line_dedup", "op11_vector_codes",
                                  "op12_source_mix", "op13_merkle_manifest"])
def test_query_matches_sql(spark, name):
    from check_oracle import compare, duck
    got = entry().queries()[name](spark, SF01).toPandas()
    assert compare(got, duck(SF01).execute(entry().oracle_sql()[name]).df()) == "OK"


def test_pipeline_against_brute_force(spark):
    """Every stage on its own input, against the direct form of its rule."""
    import corpus_pipeline as P
    from fernrec.llm.near_dedup import shingle_set
    from fernrec.llm.tokens import WORD_BPE, load_tokenizer, vocabulary_path
    from test_decontamination import brute as contaminated
    from test_line_dedup import brute as repeated
    from test_near_dedup import brute as groups
    docs = P.read_table(spark, SF001, "documents")
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(P.written(stage(spark, tables[-1], SF001), name))
    for t in tables[:5]:
        assert t.columns == docs.columns
    rows = [sorted((r.doc_id, r.text) for r in t.select("doc_id", "text").collect())
            for t in tables[:5]]
    assert set(rows[1]) <= set(rows[0])
    gone = {(d, n) for d, n, _ in repeated(rows[1])}
    kept = [(d, "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone), t)
            for d, t in rows[1]]
    assert rows[2] == [(d, t) for d, t, old in kept if t == old or t.split()]
    found = groups(rows[2], 5, 80)
    assert rows[3] == [r for r in rows[2] if found[r][2]]
    assert shingle_set("a b", 5) == {(b"a", b"b")}
    items = [tuple(r) for r in P.read_table(spark, SF001, "benchmark").select(
        "item_id", "text").collect()]
    bad = {r[0] for r in contaminated(rows[3], items) if r[-1]}
    assert rows[4] == [r for r in rows[3] if r[0] not in bad] and bad
    tok = load_tokenizer(vocabulary_path(WORD_BPE))
    last = {r.doc_id: r.n_tokens for r in tables[5].collect()}
    assert last == {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in rows[4]}


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as P
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF001}/{name}.parquet").limit(0).write.parquet(
            str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
