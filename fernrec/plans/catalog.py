"""Registered queries: each operator run over the driver tables, with its
plain-SQL statement (``oracle``) for the DuckDB check.

Interaction sources (ids cast to STRING, time as epoch microseconds):

* EV = ``events`` as (user_id, props ``$.k``, ts)
* OL = ``orders JOIN lineitem`` as (o_custkey, l_partkey, o_orderdate)

Model values are rounded (6 or 9 places) on both sides; training queries use
``dtype="float64"`` so no float32 cast has to be mirrored in SQL.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig, RuntimeConfig
from ..functions.columns import epoch_micros, round6
from ..operators import prepare as prep_ops
from ..operators.factors import factors_long, gram_table
from ..operators.scoring import evaluate, heldout_rank, hr_ndcg, recommend_topk, sample_users
from ..operators.topk import recommend_pruned
from ..operators.weights import all_item_weights, history_summary, item_weights
from ..session import materialize, release, scratch_path
from ..sources.tables import events_interactions, order_line_interactions, table_path
from ..sources.text import (load_interactions, parse_records, record_text,
                            sample_first_records, write_review_text)
from . import oracle as O
from .end_to_end import (load_factors, load_id_maps, load_metrics, load_stats, load_train_log, run,
                         save_artifacts)
from .prepare import Prepared, prepare
from .store import load_prepared, save_prepared
from .train import initial_factors, item_step, layouts, train, user_step

# Parameters of the checks (fixed per query, never tuned per result).
EV_MODEL = ModelConfig(factors=4, reg_lambda=0.01, c0=16.0, alpha=0.5, iterations=1, topk=10,
                       min_user_interactions=10, min_item_interactions=10, dtype="float64")
OL_KCORE = 23
SMOKE_RECORDS = 10_000
SAMPLE_USERS = 50
TOPK = 10


def r9(col):
    return F.round(col, 9) + F.lit(0.0)


# ---------------------------------------------------------------- shared state

_lock = threading.RLock()
_cache: dict = {}


def _cached(spark: SparkSession, key: tuple, build: Callable):
    full = (id(spark.sparkContext), spark.sparkContext.applicationId) + key
    with _lock:
        if full not in _cache:
            _cache[full] = build()
        return _cache[full]


def ev_prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    return _cached(spark, ("ev_prep", sf_dir), lambda: prepare(
        events_interactions(spark, sf_dir), EV_MODEL, RuntimeConfig()))


def ev_factors(spark: SparkSession, sf_dir: str):
    """(prepared, P0, Q0) on EV."""
    def build():
        prep = ev_prepared(spark, sf_dir)
        p0, q0 = initial_factors(prep, EV_MODEL)
        p0, _ = materialize(p0, "ev_p0")
        q0, _ = materialize(q0, "ev_q0")
        return prep, p0, q0
    return _cached(spark, ("ev_factors", sf_dir), build)


def ev_layouts(spark: SparkSession, sf_dir: str):
    """User and item layout on EV, built once for all half-steps."""
    # small heavy threshold: the check exercises both update paths
    return _cached(spark, ("ev_layouts", sf_dir), lambda: layouts(
        ev_prepared(spark, sf_dir), RuntimeConfig(heavy_threshold=60)))


def ev_model(spark: SparkSession, sf_dir: str):
    """(prepared, P0, Q0, P1, Q1) for one training iteration on EV."""
    def build():
        prep, p0, q0 = ev_factors(spark, sf_dir)
        ul, il = ev_layouts(spark, sf_dir)
        p1, _ = materialize(user_step(ul, p0, q0, prep.weights, EV_MODEL), "ev_p1")
        q1, _ = materialize(item_step(il, q0, p1, EV_MODEL), "ev_q1")
        return prep, p0, q0, p1, q1
    return _cached(spark, ("ev_model", sf_dir), build)


def ol_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep_ops.dedup_latest(order_line_interactions(spark, sf_dir))


# ---------------------------------------------------------------- sources

def q_parse_review_text(spark, sf_dir):
    """S1 + S2 + F1: OL written as review text (4 layouts), read back, parsed."""
    def build():
        lines = spark.read.parquet(table_path(sf_dir, "lineitem")).select(
            "l_orderkey", "l_partkey", "l_linenumber")
        orders = spark.read.parquet(table_path(sf_dir, "orders")).select(
            "o_orderkey", "o_custkey", "o_orderdate")
        src = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        text = src.select(record_text(F.col("o_custkey"), F.col("l_partkey"),
                                      epoch_micros("o_orderdate"), F.col("l_orderkey"),
                                      F.col("l_linenumber")).alias("text"))
        path = scratch_path(spark, "review_text")
        write_review_text(text, path)
        return path
    path = _cached(spark, ("review_text", sf_dir), build)
    return load_interactions(spark, path)


def q_sample_first_records(spark, sf_dir):
    """S3: first 10,000 records in file order of key-sorted review text."""
    def build():
        lines = spark.read.parquet(table_path(sf_dir, "lineitem")).select(
            "l_orderkey", "l_partkey", "l_linenumber")
        orders = spark.read.parquet(table_path(sf_dir, "orders")).select(
            "o_orderkey", "o_custkey", "o_orderdate")
        src = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        text = src.select("l_orderkey", "l_linenumber", "l_partkey",
                          record_text(F.col("o_custkey"), F.col("l_partkey"),
                                      epoch_micros("o_orderdate"), F.col("l_linenumber"),
                                      F.col("l_linenumber")).alias("text"))
        path = scratch_path(spark, "review_text_sorted")
        write_review_text(text, path, sort_cols=["l_orderkey", "l_linenumber", "l_partkey"])
        return path
    path = _cached(spark, ("review_text_sorted", sf_dir), build)
    sample = sample_first_records(spark, path, SMOKE_RECORDS)
    return parse_records(sample, keep=("pos",))


# ---------------------------------------------------------------- preparation

def q_dedup_latest(spark, sf_dir):
    return ol_dedup(spark, sf_dir)


def q_user_min_count(spark, sf_dir):
    return prep_ops.filter_user_min_count(ol_dedup(spark, sf_dir), OL_KCORE)


def q_item_min_count(spark, sf_dir):
    return prep_ops.filter_item_min_count(ol_dedup(spark, sf_dir), OL_KCORE)


def q_k_core(spark, sf_dir):
    """I1 on the indexed adjacency, as a table beyond SCAN_ROWS takes it."""
    return prep_ops.k_core(ol_dedup(spark, sf_dir), OL_KCORE, OL_KCORE, scan_rows=0).interactions


CHAIN = 48


def chain_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a user between two neighbouring items of its chain of 48
    orders; every fourth chain is closed to a ring. The open chains' 2/2-core
    peels off one end per round, the rings stay."""
    orders = spark.read.parquet(table_path(sf_dir, "orders")).select("o_orderkey", "o_orderdate")
    chain, at = F.floor(F.col("o_orderkey") / CHAIN), F.pmod("o_orderkey", F.lit(CHAIN))
    after = F.when(F.pmod(chain, F.lit(4)) == 0, F.pmod(at + 1, F.lit(CHAIN))).otherwise(at + 1)
    item = F.explode(F.array(at, after))
    return orders.select(F.col("o_orderkey").cast("string").alias("user_id"),
                         chain.cast("string").alias("chain"), item.alias("at"),
                         epoch_micros("o_orderdate").alias("ts")).select(
        "user_id", F.concat_ws("-", "chain", F.col("at").cast("string")).alias("item_id"), "ts")


def q_k_core_deep(spark, sf_dir):
    """I1 on a cascade of more than twelve rounds."""
    return prep_ops.k_core(prep_ops.dedup_latest(chain_interactions(spark, sf_dir)),
                           2, 2).interactions


def q_dense_index_users(spark, sf_dir):
    return prep_ops.dense_index(ol_dedup(spark, sf_dir), "user_id", "user_idx")


def q_dense_index_items(spark, sf_dir):
    return prep_ops.dense_index(ol_dedup(spark, sf_dir), "item_id", "item_idx")


def q_indexed_interactions(spark, sf_dir):
    return ev_prepared(spark, sf_dir).indexed


def _ol_split(spark, sf_dir):
    def build():
        # read by both indexes, the hot ids and the join: written once
        dedup, _ = materialize(ol_dedup(spark, sf_dir), "ol_dedup")
        ix = prep_ops.index_interactions(dedup)
        indexed, _ = materialize(ix.interactions, "ol_indexed")
        release(dedup)
        return prep_ops.leave_one_out(indexed)
    return _cached(spark, ("ol_split", sf_dir), build)


def q_split_train(spark, sf_dir):
    return _ol_split(spark, sf_dir).train


def q_split_test(spark, sf_dir):
    return _ol_split(spark, sf_dir).test


def q_item_weights(spark, sf_dir):
    prep = ev_prepared(spark, sf_dir)
    w = item_weights(prep.train, EV_MODEL.c0, EV_MODEL.alpha)
    return all_item_weights(prep.item_index, w).select("item_idx", r9(F.col("c")).alias("c"))


def q_user_history(spark, sf_dir):
    h = ev_prepared(spark, sf_dir).hist
    return h.select("user_idx", "item_idx", r9(F.col("c")).alias("c"))


def q_item_history(spark, sf_dir):
    h = ev_prepared(spark, sf_dir).hist
    s = history_summary(h, "item_idx")
    w = h.groupBy("item_idx").agg(F.max("c").alias("c"))
    return s.join(w, "item_idx").select("item_idx", r9(F.col("c")).alias("c"),
                                        F.col("n").alias("n_users"))


# ---------------------------------------------------------------- model

def _long(df: DataFrame, side: str, places: int = 9) -> DataFrame:
    rnd = r9 if places == 9 else round6
    return factors_long(df).select(F.lit(side).alias("side"), "idx", "f",
                                   rnd(F.col("v")).alias("v"))


def q_factor_init(spark, sf_dir):
    prep = ev_prepared(spark, sf_dir)
    p0, q0 = initial_factors(prep, EV_MODEL)
    return _long(p0, "user").unionByName(_long(q0, "item"))


def _gram_long(g: DataFrame) -> DataFrame:
    return g.select(F.col("f").cast("bigint").alias("f"), F.col("g").cast("bigint").alias("g"),
                    r9(F.col("v")).alias("v"))


def q_gram_items(spark, sf_dir):
    prep, p0, q0, _, _ = ev_model(spark, sf_dir)
    return _gram_long(gram_table(q0, EV_MODEL.factors, prep.weights))


def q_gram_users(spark, sf_dir):
    _, p0, _, _, _ = ev_model(spark, sf_dir)
    return _gram_long(gram_table(p0, EV_MODEL.factors))


def q_user_half_step(spark, sf_dir):
    _, _, _, p1, _ = ev_model(spark, sf_dir)
    return _long(p1, "user", 6)


def q_item_half_step(spark, sf_dir):
    """Item half-step from the initial factors (P0 fixed)."""
    _, p0, q0 = ev_factors(spark, sf_dir)
    _, il = ev_layouts(spark, sf_dir)
    return _long(item_step(il, q0, p0, EV_MODEL), "item", 6)


def q_train_one_iteration(spark, sf_dir):
    _, _, _, p1, q1 = ev_model(spark, sf_dir)
    return _long(p1, "user", 6).unionByName(_long(q1, "item", 6))


def q_prepared_roundtrip(spark, sf_dir):
    """The prepared set saved, loaded, and trained from."""
    path = scratch_path(spark, "prepared")
    save_prepared(ev_prepared(spark, sf_dir), path)
    fitted = train(load_prepared(spark, path), EV_MODEL, RuntimeConfig(heavy_threshold=60))
    return _long(fitted.p, "user", 6).unionByName(_long(fitted.q, "item", 6))


def q_resumed_training(spark, sf_dir):
    """A run that committed its iteration and is started again."""
    prep, state = ev_prepared(spark, sf_dir), scratch_path(spark, "training")
    runtime = RuntimeConfig(heavy_threshold=60, rows_per_block=500)
    train(prep, EV_MODEL, runtime, state=state)
    fitted = train(prep, EV_MODEL, runtime, state=state)
    return _long(fitted.p, "user", 6).unionByName(_long(fitted.q, "item", 6))


# ---------------------------------------------------------------- evaluation

def _ranks(spark, sf_dir):
    prep, _, _, p1, q1 = ev_model(spark, sf_dir)
    # small blocks: the check exercises several user and item blocks
    return heldout_rank(prep.test, prep.train, p1, q1, prep.num_users, prep.num_items,
                        block_users=64, block_items=32)


def q_heldout_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)


def q_hr_ndcg_per_user(spark, sf_dir):
    m = hr_ndcg(_ranks(spark, sf_dir), EV_MODEL.topk)
    return m.select("user_idx", "rank", r9(F.col("hr")).alias("hr"), r9(F.col("ndcg")).alias("ndcg"))


def _evaluated(spark, sf_dir, sample: int | None) -> DataFrame:
    prep, _, _, p1, q1 = ev_model(spark, sf_dir)
    _, m = evaluate(prep.test, prep.train, p1, q1, EV_MODEL.topk, prep.num_users, prep.num_items,
                    sample, EV_MODEL.random_seed, block_users=64, block_items=32)
    return m.select(r9(F.col("hr")).alias("hr"), r9(F.col("ndcg")).alias("ndcg"),
                    "evaluated_users")


def q_evaluate(spark, sf_dir):
    return _evaluated(spark, sf_dir, None)


def q_evaluate_sample(spark, sf_dir):
    """E4 + E5: only the sampled users are scored."""
    return _evaluated(spark, sf_dir, SAMPLE_USERS)


TWINS = 25


def q_heldout_rank_ties(spark, sf_dir):
    """W4 with equal real-valued scores: items share a vector modulo 25."""
    prep, p0, q0, _, _ = ev_model(spark, sf_dir)
    twin = q0.select(F.col("idx").alias("_twin"), "vec")
    q = (prep.item_index.select(F.col("item_idx").alias("idx"))
         .join(twin, F.pmod("idx", F.lit(TWINS)) == F.col("_twin")).select("idx", "vec"))
    return heldout_rank(prep.test, prep.train, p0, q, prep.num_users, prep.num_items,
                        block_users=64, block_items=32)


def q_recommend_topk(spark, sf_dir):
    prep, _, _, p1, q1 = ev_model(spark, sf_dir)
    rec = recommend_topk(prep.test, prep.train, p1, q1, TOPK, prep.num_users, prep.num_items,
                         block_users=64, block_items=32)
    return rec.select("user_idx", "rank", "item_idx", r9(F.col("score")).alias("score"))


def q_recommend_topk_pruned(spark, sf_dir):
    """W3 by bands of descending norm: the rows of ``recommend_topk``."""
    prep, _, _, p1, q1 = ev_model(spark, sf_dir)
    rec = recommend_pruned(prep.test, prep.train, p1, q1, TOPK, block_users=64, block_items=8)
    return rec.frame.select("user_idx", "rank", "item_idx", r9(F.col("score")).alias("score"))


def q_sample_users(spark, sf_dir):
    prep = ev_prepared(spark, sf_dir)
    return sample_users(prep.test, SAMPLE_USERS, EV_MODEL.random_seed)


# ---------------------------------------------------------------- stats, artifacts

STAT_STAGES = ("raw_interactions", "deduped_interactions", "filtered_interactions",
               "num_users", "num_items", "indexed_interactions", "train_interactions",
               "test_users", "weighted_items", "user_histories", "item_histories")


def q_prepare_stats(spark, sf_dir):
    m = ModelConfig(min_user_interactions=OL_KCORE, min_item_interactions=OL_KCORE)
    prep = _cached(spark, ("ol_prep", sf_dir), lambda: prepare(
        order_line_interactions(spark, sf_dir), m, RuntimeConfig()))
    rows = [(k, float(prep.stats[k])) for k in STAT_STAGES]
    return spark.createDataFrame(rows, "stage string, value double")


def ev_artifacts(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the artifacts of one whole run (prepare, train, evaluate)."""
    def build():
        result = run(events_interactions(spark, sf_dir), EV_MODEL,
                     RuntimeConfig(heavy_threshold=60, eval_block_users=64, eval_block_items=32))
        out = scratch_path(spark, "artifacts")
        save_artifacts(result, out, EV_MODEL)
        return out
    return _cached(spark, ("ev_artifacts", sf_dir), build)


def q_artifact_roundtrip(spark, sf_dir):
    """Factors that ``train`` made and ``save_artifacts`` wrote."""
    p, q = load_factors(spark, ev_artifacts(spark, sf_dir))
    return _long(p, "user", 6).unionByName(_long(q, "item", 6))


def q_saved_metrics(spark, sf_dir):
    """S6 of a run."""
    m = load_metrics(spark, ev_artifacts(spark, sf_dir))
    return m.select(r9(F.col("hr")).alias("hr"), r9(F.col("ndcg")).alias("ndcg"),
                    "evaluated_users")


def q_saved_stats(spark, sf_dir):
    """S7 of a run, without times and partitions."""
    return load_stats(spark, ev_artifacts(spark, sf_dir)).filter(
        F.col("stage").isin(*STAT_STAGES))


def q_saved_train_log(spark, sf_dir):
    """S8 of a run, without times."""
    return load_train_log(spark, ev_artifacts(spark, sf_dir)).select("iteration")


def q_saved_id_maps(spark, sf_dir):
    """S9, W5 of a run."""
    users, items = load_id_maps(spark, ev_artifacts(spark, sf_dir))
    return users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"),
                        F.col("user_idx").alias("idx")).unionByName(
        items.select(F.lit("item").alias("side"), F.col("item_id").alias("id"),
                     F.col("item_idx").alias("idx")))


def q_no_test_users(spark, sf_dir):
    """A core that leaves nobody is refused before training."""
    m = EV_MODEL.with_(min_user_interactions=1_000_000)
    try:
        run(events_interactions(spark, sf_dir), m, RuntimeConfig())
        refused = False
    except ValueError:
        refused = True
    return events_interactions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


# ---------------------------------------------------------------- registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_review_text": q_parse_review_text,
    "sample_first_records": q_sample_first_records,
    "dedup_latest": q_dedup_latest,
    "user_min_count": q_user_min_count,
    "item_min_count": q_item_min_count,
    "k_core": q_k_core,
    "k_core_deep": q_k_core_deep,
    "dense_index_users": q_dense_index_users,
    "dense_index_items": q_dense_index_items,
    "indexed_interactions": q_indexed_interactions,
    "split_train": q_split_train,
    "split_test": q_split_test,
    "item_weights": q_item_weights,
    "user_history": q_user_history,
    "item_history": q_item_history,
    "factor_init": q_factor_init,
    "gram_items": q_gram_items,
    "gram_users": q_gram_users,
    "user_half_step": q_user_half_step,
    "item_half_step": q_item_half_step,
    "train_one_iteration": q_train_one_iteration,
    "prepared_roundtrip": q_prepared_roundtrip,
    "resumed_training": q_resumed_training,
    "heldout_rank": q_heldout_rank,
    "hr_ndcg_per_user": q_hr_ndcg_per_user,
    "heldout_rank_ties": q_heldout_rank_ties,
    "evaluate": q_evaluate,
    "evaluate_sample": q_evaluate_sample,
    "recommend_topk": q_recommend_topk,
    "recommend_topk_pruned": q_recommend_topk_pruned,
    "sample_users": q_sample_users,
    "prepare_stats": q_prepare_stats,
    "artifact_roundtrip": q_artifact_roundtrip,
    "saved_metrics": q_saved_metrics,
    "saved_stats": q_saved_stats,
    "saved_train_log": q_saved_train_log,
    "saved_id_maps": q_saved_id_maps,
    "no_test_users": q_no_test_users,
}


def oracle_sql() -> dict[str, str]:
    m = EV_MODEL
    k = m.factors
    ev_prep = O.prepared_ctes("ev", m)
    ol = [O.OL_SQL, O.dedup_cte("ol")]
    ol_kc = ModelConfig(min_user_interactions=OL_KCORE, min_item_interactions=OL_KCORE)
    ol_prep = O.prepared_ctes("ol", ol_kc)
    train_ctes, p1, q1 = O.train_one_iteration_ctes(m)
    model_ctes = ev_prep + train_ctes
    ui, qi_final = O.half_step_ctes("qh", "item", "q0", "p0", "sp0", m)
    ranked = model_ctes + O.score_ctes(p1, q1, k) + O.rank_ctes()
    per_user = (f"SELECT user_idx, rank, "
                f"{O.r(f'CASE WHEN rank <= {m.topk} THEN 1.0 ELSE 0.0 END', 9)} AS hr, "
                f"{O.r(f'CASE WHEN rank <= {m.topk} THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END', 9)}"
                f" AS ndcg FROM rk")
    stats_body = " UNION ALL ".join([
        "SELECT 'raw_interactions' AS stage, CAST(count(*) AS DOUBLE) AS value FROM {src}",
        "SELECT 'deduped_interactions', CAST(count(*) AS DOUBLE) FROM dd",
        "SELECT 'filtered_interactions', CAST(count(*) AS DOUBLE) FROM kc",
        "SELECT 'num_users', CAST(count(*) AS DOUBLE) FROM uix",
        "SELECT 'num_items', CAST(count(*) AS DOUBLE) FROM iix",
        "SELECT 'indexed_interactions', CAST(count(*) AS DOUBLE) FROM ix",
        "SELECT 'train_interactions', CAST(count(*) AS DOUBLE) FROM train",
        "SELECT 'test_users', CAST(count(*) AS DOUBLE) FROM test",
        "SELECT 'weighted_items', CAST(count(*) AS DOUBLE) FROM wt",
        "SELECT 'user_histories', CAST(count(DISTINCT user_idx) AS DOUBLE) FROM hist",
        "SELECT 'item_histories', CAST(count(DISTINCT item_idx) AS DOUBLE) FROM hist",
    ])
    sampled = ("SELECT user_idx, test_item_idx, n_train FROM test ORDER BY "
               f"md5(concat_ws(':', '{m.random_seed}', CAST(user_idx AS VARCHAR))), "
               f"user_idx LIMIT {SAMPLE_USERS}")
    metrics = (f"SELECT {O.r('coalesce(avg(hr), 0.0)', 9)} AS hr, "
               f"{O.r('coalesce(avg(ndcg), 0.0)', 9)} AS ndcg, "
               "count(*) AS evaluated_users FROM pu")
    evaluated = O.with_(ranked + [f"pu AS ({per_user})"], metrics)
    factors = O.vec_long(p1, k, 6, "user") + " UNION ALL " + O.vec_long(q1, k, 6, "item")
    twins = (f"qt AS (SELECT i.item_idx AS idx, {', '.join(O.xs(k, 'q0'))} FROM iix i "
             f"JOIN q0 ON q0.idx = i.item_idx % {TWINS})")
    ring = (f"CASE WHEN (o_orderkey // {CHAIN}) % 4 = 0 THEN (o_orderkey + 1) % {CHAIN} "
            f"ELSE o_orderkey % {CHAIN} + 1 END")
    chains = ("ch AS (SELECT CAST(o_orderkey AS VARCHAR) AS user_id, "
              f"concat_ws('-', CAST(o_orderkey // {CHAIN} AS VARCHAR), CAST(unnest(["
              f"o_orderkey % {CHAIN}, {ring}]) AS VARCHAR)) AS item_id, "
              "epoch_us(o_orderdate) AS ts FROM orders)")
    sorted_src = ("src AS (SELECT CAST(o.o_custkey AS VARCHAR) AS user_id, "
                  "CAST(l.l_partkey AS VARCHAR) AS item_id, epoch_us(o.o_orderdate) AS ts, "
                  "l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN orders o "
                  "ON l.l_orderkey = o.o_orderkey)")
    return {
        "parse_review_text": O.with_([O.OL_SQL], "SELECT user_id, item_id, ts FROM ol"),
        "sample_first_records": O.with_(
            [sorted_src],
            "SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 "
            "AS BIGINT) AS pos, user_id, item_id, ts FROM src "
            f"ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT {SMOKE_RECORDS}"),
        "dedup_latest": O.with_(ol, "SELECT user_id, item_id, ts FROM dd"),
        "user_min_count": O.with_(ol + [O.min_count_cte("dd", "user_id", OL_KCORE, "f")],
                                  "SELECT user_id, item_id, ts FROM f"),
        "item_min_count": O.with_(ol + [O.min_count_cte("dd", "item_id", OL_KCORE, "f")],
                                  "SELECT user_id, item_id, ts FROM f"),
        "k_core": O.with_(ol + O.kcore_ctes("dd", OL_KCORE, OL_KCORE),
                          "SELECT user_id, item_id, ts FROM kc"),
        "k_core_deep": O.with_([chains, O.dedup_cte("ch")]
                               + O.kcore_ctes("dd", 2, 2, rounds=2 * CHAIN),
                               "SELECT user_id, item_id, ts FROM kc"),
        "dense_index_users": O.with_(ol + O.index_ctes("dd"), "SELECT user_id, user_idx FROM uix"),
        "dense_index_items": O.with_(ol + O.index_ctes("dd"), "SELECT item_id, item_idx FROM iix"),
        "indexed_interactions": O.with_(ev_prep, "SELECT user_idx, item_idx, ts FROM ix"),
        "split_train": O.with_(ol + O.index_ctes("dd") + O.split_ctes(),
                               "SELECT user_idx, item_idx FROM train"),
        "split_test": O.with_(ol + O.index_ctes("dd") + O.split_ctes(),
                              "SELECT user_idx, test_item_idx, n_train FROM test"),
        "item_weights": O.with_(ev_prep, f"SELECT i.item_idx, {O.r('coalesce(w.c, 0.0)', 9)} AS c "
                                         "FROM iix i LEFT JOIN wt w ON w.item_idx = i.item_idx"),
        "user_history": O.with_(ev_prep, f"SELECT user_idx, item_idx, {O.r('c', 9)} AS c FROM hist"),
        "item_history": O.with_(ev_prep, f"SELECT item_idx, {O.r('max(c)', 9)} AS c, "
                                         "count(*) AS n_users FROM hist GROUP BY item_idx"),
        "factor_init": O.with_(ev_prep + O.init_ctes(m),
                               O.vec_long("p0", k, 9, "user") + " UNION ALL "
                               + O.vec_long("q0", k, 9, "item")),
        "gram_items": O.with_(ev_prep + O.init_ctes(m) + [O.gram_cte("g", "q0", k, True)],
                              O.gram_long("g", k)),
        "gram_users": O.with_(ev_prep + O.init_ctes(m) + [O.gram_cte("g", "p0", k, False)],
                              O.gram_long("g", k)),
        "user_half_step": O.with_(model_ctes, O.vec_long(p1, k, 6, "user")),
        "item_half_step": O.with_(ev_prep + O.init_ctes(m) + [O.gram_cte("sp0", "p0", k, False)]
                                  + ui, O.vec_long(qi_final, k, 6, "item")),
        **dict.fromkeys(("train_one_iteration", "prepared_roundtrip", "resumed_training"),
                        O.with_(model_ctes, O.vec_long(p1, k, 6, "user") + " UNION ALL "
                                + O.vec_long(q1, k, 6, "item"))),
        "heldout_rank": O.with_(ranked, "SELECT user_idx, test_item_idx, rank FROM rk"),
        "hr_ndcg_per_user": O.with_(ranked, per_user),
        "heldout_rank_ties": O.with_(
            ev_prep + O.init_ctes(m) + [twins] + O.score_ctes("p0", "qt", k) + O.rank_ctes(),
            "SELECT user_idx, test_item_idx, rank FROM rk"),
        "evaluate": evaluated,
        "evaluate_sample": O.with_(
            ranked + [f"chosen AS ({sampled})", f"pu AS ({per_user} SEMI JOIN chosen "
                      "ON chosen.user_idx = rk.user_idx)"], metrics),
        "saved_metrics": evaluated,
        "saved_stats": O.with_(ev_prep, stats_body.format(src="ev")),
        "saved_train_log": f"SELECT CAST(i AS INTEGER) AS iteration FROM range(1, "
                           f"{m.iterations + 1}) t(i)",
        "saved_id_maps": O.with_(ev_prep, "SELECT 'user' AS side, user_id AS id, user_idx AS idx "
                                 "FROM uix UNION ALL SELECT 'item', item_id, item_idx FROM iix"),
        "no_test_users": O.with_([O.EV_SQL], "SELECT count(*) AS n, true AS refused FROM ev"),
        **dict.fromkeys(("recommend_topk", "recommend_topk_pruned"), O.with_(
            model_ctes + O.score_ctes(p1, q1, k),
            f"SELECT user_idx, rank, item_idx, {O.r('s', 9)} AS score FROM ("
            "SELECT c.user_idx, c.item_idx, c.s, CAST(row_number() OVER (PARTITION BY c.user_idx "
            "ORDER BY c.s DESC, c.item_idx ASC) AS BIGINT) AS rank FROM cand c "
            "JOIN test t ON t.user_idx = c.user_idx) z "
            f"WHERE rank <= {TOPK}")),
        "sample_users": O.with_(ev_prep, sampled),
        "prepare_stats": O.with_(ol_prep, stats_body.format(src="ol")),
        "artifact_roundtrip": O.with_(model_ctes, factors),
    }
