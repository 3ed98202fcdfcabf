"""One query per operator, with its SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_bpe import encode_documents
from .common import read_table
from .decontamination import contamination
from .html_blocks import extract_main_text
from .language_id import identify_languages
from .line_dedup import line_dedup
from .merkle_manifest import merkle_proofs
from .near_dedup import near_duplicates
from .quality_rules import quality_rules
from .source_mix import mix_sources, taken_words
from .token_counts import count_tokens
from .token_files import token_digests
from .toxicity import score_toxicity
from .vector_codes import compress_vectors


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"),
                         read_table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("_k", "first")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(read_table(spark, sf_dir, "documents"),
                           read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_words", "best",
                        F.size("passages").alias("n_passages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), full=False)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(read_table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_proofs(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_chunk_bpe": op9_chunk_bpe,
    "op10_html_extraction": op10_html_extraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_mix": op12_source_mix,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS size,
         unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM bi),
di AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
       FROM d CROSS JOIN (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
hits AS (SELECT doc_id, i, di.size, item FROM di
         JOIN bw ON bw.size = di.size AND bw.gram = array_to_string(w[i:i + di.size - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

_OP8_SQL = r"""
WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
w AS (
  SELECT doc_id, line_no, regexp_extract_all(translate(line,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM ln),
o AS (
  SELECT doc_id, line_no, w, len(w) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS pos
  FROM w WHERE len(w) >= 1),
f AS (SELECT w, n, min(pos) AS pos FROM o GROUP BY w, n),
k AS (
  SELECT pos, n, w, 0 AS side, w[1:2] AS run FROM f WHERE n >= 5
  UNION ALL SELECT pos, n, w, 1, w[n - 1:n] FROM f WHERE n >= 5),
near AS (
  SELECT DISTINCT b.pos FROM k a JOIN k b
    ON a.side = b.side AND a.run = b.run AND a.pos < b.pos AND abs(a.n - b.n) <= 1
  WHERE CASE
    WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) <= 1
    WHEN a.n < b.n THEN len(list_filter(range(1, b.n + 1), lambda i:
      list_concat(b.w[:i - 1], b.w[i + 1:]) = a.w)) > 0
    ELSE len(list_filter(range(1, a.n + 1), lambda i:
      list_concat(a.w[:i - 1], a.w[i + 1:]) = b.w)) > 0 END),
gone AS (
  SELECT o.doc_id, sum(CASE WHEN o.pos <> f.pos THEN 1 ELSE 0 END) AS n_repeated,
    sum(CASE WHEN o.pos = f.pos AND near.pos IS NOT NULL THEN 1 ELSE 0 END) AS n_near
  FROM o JOIN f ON f.w = o.w LEFT JOIN near ON near.pos = o.pos GROUP BY o.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""


def _op11_sql() -> str:
    """Lloyd's rounds over all parts, unrolled; every piece against every entry."""
    ctes = [r"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", r"""
y AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 8) + 1:(p + 1) * (len(x) // 8)] AS y
  FROM v, (SELECT unnest(range(8)) AS p))""", r"""
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, y AS c FROM y WHERE r <= 16)"""]
    for k in range(7):
        ctes.append(f"""
a{k} AS MATERIALIZED (SELECT r, p, y, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (
    SELECT r, y.p, y, e, list_sum(list_transform(list_zip(y, c),
      lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS d
    FROM y JOIN c{k} c ON c.p = y.p) GROUP BY r, p, y)""")
        if k < 6:
            ctes.append(f"""
m{k} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT p, e, i, sum(z) AS s, count(*) AS n FROM (
        SELECT p, e, unnest(y) AS z, generate_subscripts(y, 1) AS i FROM a{k})
      GROUP BY p, e, i)) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c
  FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)""")
    ctes.append(r"""
f AS (SELECT v.vec_id, v.label, g.code, g.error FROM v JOIN (
    SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code,
      CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r) g ON g.r = v.r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  h AS codebooks_sha256 FROM f, h""")
    return "WITH " + ",".join(ctes)


_OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS g, CAST(coalesce(len(
    regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT g, size, [5, 2, 1][CAST((row_number() OVER (ORDER BY g) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM (SELECT g, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY g)),
o AS (
  SELECT 2.0 * size / w AS r,
    (1.5 * (SELECT sum(size) FROM s) - coalesce(sum(2 * size) OVER (ORDER BY 2.0 * size / w, g
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER (
      ORDER BY 2.0 * size / w, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s),
t AS (
  SELECT g, size, least((2 * size)::DOUBLE, w * (SELECT arg_min(level, r) FROM o WHERE level <= r)) AS target
  FROM s),
q AS (SELECT g, size, target, least(2 * size, CAST(floor(target + 0.5) AS BIGINT)) AS quota FROM t),
p AS (
  SELECT doc_id, g, size, CAST(coalesce(sum(size) OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
b AS (SELECT g, size, quota, unnest(range((size + 511) // 512)) AS block FROM q),
u AS (
  SELECT g, block, quota, least(512, size - block * 512) AS n, turn,
    md5('0|' || turn || '|' || g || '|' || block) AS h
  FROM b, (SELECT unnest([0, 1]) AS turn) WHERE turn * size < quota),
c AS (
  SELECT g, block, least(n, quota - before) AS n FROM (
    SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY g ORDER BY turn, h, block
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM u)
  WHERE before < quota),
k AS (
  SELECT p.doc_id, sum(greatest(0, least(start + size, block * 512 + n)
    - greatest(start, block * 512))) AS taken
  FROM p JOIN c ON c.g = p.g AND block * 512 < start + size AND start < block * 512 + 512
  GROUP BY p.doc_id)
SELECT p.doc_id, p.size, q.size AS source_size, q.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM p JOIN q ON q.g = p.g LEFT JOIN k ON k.doc_id = p.doc_id
"""


def _op13_sql(source_levels: int = 6, top_levels: int = 5) -> str:
    """The trees level by level (as many as 16 to the power of the levels leaves)."""
    def field(c: str, text: str) -> str:
        return (f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END")

    def leaf(text: str) -> str:
        rest = [field(c, f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")]
        return "sha256(" + " || ".join(f"({f})" for f in [*rest, field("text", text)]) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit: a byte is mixed in, then eight shifts (marked -1)
    crc = ("list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform("
           "string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], "
           "list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))), lambda a, x: CASE "
           "WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)")
    ctes = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS g, {leaf('text')} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS changed
  FROM documents)""", """
n0 AS MATERIALIZED (SELECT g, leaf AS h, doc_id, row_number() OVER (
    PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d)"""]

    def level(src: str, dst: str) -> str:
        return f"""
{dst} AS MATERIALIZED (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1
    THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
  FROM {src} GROUP BY g, i // 16, n)"""

    def around(src: str, dst: str) -> str:
        return f"""
{dst} AS MATERIALIZED (SELECT a.g, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i)
      FILTER (b.i < a.i), '') AS pre, coalesce(string_agg(b.h, '' ORDER BY b.i)
      FILTER (b.i > a.i), '') AS post
  FROM {src} a JOIN {src} b ON b.g = a.g AND b.i // 16 = a.i // 16 GROUP BY a.g, a.i, a.n)"""
    for k in range(source_levels):
        ctes += [level(f"n{k}", f"n{k + 1}"), around(f"n{k}", f"s{k}")]
    ctes.append(f"""
t0 AS MATERIALIZED (SELECT '' AS g, g AS tree, h, row_number() OVER (ORDER BY g) - 1 AS i,
    count(*) OVER () AS n FROM n{source_levels})""")
    for k in range(top_levels):
        ctes += [level(f"t{k}", f"t{k + 1}"), around(f"t{k}", f"r{k}")]
    ctes.append("""
f0 AS MATERIALIZED (SELECT d.doc_id, d.leaf, d.g, n0.i, t0.i AS ti, t0.h AS subroot,
    d.changed AS f, '' AS proof FROM d JOIN n0 ON n0.g = d.g AND n0.h = d.leaf
    AND n0.doc_id IS NOT DISTINCT FROM d.doc_id JOIN t0 ON t0.tree = d.g)""")
    steps = ([(f"s{k}", "f.g", "f.i", 16 ** k) for k in range(source_levels)]
             + [(f"r{k}", "''", "f.ti", 16 ** k) for k in range(top_levels)])
    for k, (src, g, i, width) in enumerate(steps):
        ctes.append(f"""
f{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (f, proof), CASE WHEN x.n > 1
    THEN sha256(pre || f.f || post) ELSE f.f END AS f, proof || pre || post AS proof
  FROM f{k} f JOIN {src} x ON x.g = {g} AND x.i = {i} // {width})""")
    return "WITH " + ",".join(ctes) + f"""
SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root,
  f.f = r.h AS verified FROM f{len(steps)} f, t{top_levels} r
"""


ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": _OP4_SQL,
    "op8_line_dedup": _OP8_SQL,
    "op11_vector_codes": _op11_sql(),
    "op12_source_mix": _OP12_SQL,
    "op13_merkle_manifest": _op13_sql(),
}
