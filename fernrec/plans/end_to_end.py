"""Prepare -> train -> evaluate, and the artifact sinks."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig, RuntimeConfig
from ..operators.scoring import evaluate
from .prepare import Prepared, prepare
from .store import load_prepared, newest, save_prepared
from .train import Model, train


@dataclass
class RunResult:
    prepared: Prepared
    model: Model
    per_user: DataFrame
    metrics: DataFrame
    eval_seconds: float


def load_review_text(spark: SparkSession, path: str | list[str],
                     runtime: RuntimeConfig | None = None) -> DataFrame:
    """Interactions from review text; in ``smoke`` mode only the first
    ``smoke_records`` records in file order (S3), else every record (S1, S2)."""
    from ..sources.text import load_interactions, parse_records, sample_first_records
    runtime = runtime or RuntimeConfig()
    if runtime.mode == "smoke":
        return parse_records(sample_first_records(spark, path, runtime.smoke_records))
    return load_interactions(spark, path, runtime.num_partitions)


def check_prepared(prep: Prepared) -> None:
    """Preparation must leave at least one test user."""
    if prep.stats.get("test_users", 0) == 0:
        raise ValueError("No test users after preparation: lower the k-core thresholds "
                         "or provide more interactions")


def run(interactions: DataFrame, model: ModelConfig,
        runtime: RuntimeConfig | None = None, state: str | None = None) -> RunResult:
    """``state``: a folder to keep the prepared set and the training state in; a
    run started again with it goes on where the last one stopped."""
    runtime = runtime or RuntimeConfig()
    spark = interactions.sparkSession
    if state and newest(spark, f"{state}/prepared") is not None:
        prep = load_prepared(spark, f"{state}/prepared")
    else:
        prep = prepare(interactions, model, runtime)
        if state:
            save_prepared(prep, f"{state}/prepared")
    check_prepared(prep)
    fitted = train(prep, model, runtime, state=f"{state}/training" if state else None)
    t = time.time()
    per_user, metrics = evaluate(
        prep.test, prep.train, fitted.p, fitted.q, model.topk, prep.num_users,
        prep.num_items, runtime.eval_user_sample, model.random_seed,
        runtime.eval_block_users, runtime.eval_block_items)
    metrics = metrics.cache()
    metrics.count()
    return RunResult(prep, fitted, per_user, metrics, time.time() - t)


def save_artifacts(result: RunResult, out_dir: str, model: ModelConfig) -> None:
    """Factors and id maps as Parquet in index order (range
    partitioned, so file order is index order), metrics, stats, train log and
    config as JSON (one file each: one row, one row per stage or iteration)."""
    spark = result.metrics.sparkSession
    out = out_dir.rstrip("/")

    def in_order(df: DataFrame, col: str) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        return df.repartitionByRange(n, col).sortWithinPartitions(col)

    for name, df in (("p", result.model.p), ("q", result.model.q)):
        in_order(df, "idx").write.mode("overwrite").parquet(f"{out}/factors_{name}")
    (result.metrics.withColumn("eval_seconds", F.lit(float(result.eval_seconds)))
     .coalesce(1).write.mode("overwrite").json(f"{out}/metrics"))
    result.prepared.stats_frame(spark).coalesce(1).write.mode("overwrite").json(
        f"{out}/prepare_stats")
    result.model.log_frame(spark).coalesce(1).write.mode("overwrite").json(f"{out}/train_log")
    spark.createDataFrame([(model.to_json(),)], "config string").coalesce(1).write.mode(
        "overwrite").text(f"{out}/config")
    in_order(result.prepared.user_index, "user_idx").write.mode("overwrite").parquet(
        f"{out}/user_ids")
    in_order(result.prepared.item_index, "item_idx").write.mode("overwrite").parquet(
        f"{out}/item_ids")


def load_factors(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Read saved factor tables back."""
    out = out_dir.rstrip("/")
    return spark.read.parquet(f"{out}/factors_p"), spark.read.parquet(f"{out}/factors_q")


def load_id_maps(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """S9 read back: (user_id, user_idx) and (item_id, item_idx)."""
    out = out_dir.rstrip("/")
    return spark.read.parquet(f"{out}/user_ids"), spark.read.parquet(f"{out}/item_ids")


def load_metrics(spark: SparkSession, out_dir: str) -> DataFrame:
    """S6 read back: hr, ndcg, evaluated_users, eval_seconds."""
    return spark.read.schema("hr double, ndcg double, evaluated_users bigint, "
                             "eval_seconds double").json(f"{out_dir.rstrip('/')}/metrics")


def load_stats(spark: SparkSession, out_dir: str) -> DataFrame:
    """S7 read back: stage, value."""
    return spark.read.schema("stage string, value double").json(
        f"{out_dir.rstrip('/')}/prepare_stats")


def load_train_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """S8 read back: iteration, seconds."""
    return spark.read.schema("iteration int, seconds double").json(
        f"{out_dir.rstrip('/')}/train_log")


def metrics_dict(metrics: DataFrame) -> dict:
    row = metrics.first()
    return {"hr": float(row["hr"]), "ndcg": float(row["ndcg"]),
            "evaluated_users": int(row["evaluated_users"])}


def metrics_json(metrics: DataFrame) -> str:
    return json.dumps(metrics_dict(metrics), indent=2)


__all__ = ["RunResult", "load_review_text", "check_prepared", "run", "save_artifacts", "load_factors",
           "load_id_maps", "load_metrics", "load_stats", "load_train_log",
           "metrics_dict", "metrics_json"]
