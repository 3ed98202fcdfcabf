"""M6: end-to-end preparation with per-stage counts and timings."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig, RuntimeConfig
from ..operators.prepare import (index_interactions, k_core, leave_one_out,
                                 train_without_test)
from ..operators.weights import histories, item_popularity, weights_from_counts
from ..session import default_partitions, materialize, release


@dataclass
class Prepared:
    num_users: int
    num_items: int
    user_index: DataFrame   # user_id, user_idx
    item_index: DataFrame   # item_id, item_idx
    indexed: DataFrame      # user_idx, item_idx, ts
    train: DataFrame        # user_idx, item_idx
    test: DataFrame         # user_idx, test_item_idx, n_train
    weights: DataFrame      # item_idx, c (items seen in train)
    hist: DataFrame         # user_idx, item_idx, c
    stats: dict = field(default_factory=dict)

    def stats_frame(self, spark: SparkSession, timings: bool = True) -> DataFrame:
        """S7 source: ``stage STRING, value DOUBLE`` rows."""
        rows = [(k, float(v)) for k, v in self.stats.items()
                if timings or not k.endswith("_seconds")]
        return spark.createDataFrame(rows, "stage string, value double")


def _stage(df: DataFrame, name: str) -> None:
    """Label the following jobs (event log / profiling tools)."""
    df.sparkSession.sparkContext.setJobDescription(f"fernrec prepare: {name}")


def prepare(interactions: DataFrame, model: ModelConfig,
            runtime: RuntimeConfig | None = None) -> Prepared:
    """Dedup -> k-core -> index -> split -> weights -> histories.

    ``interactions`` is ``user_id, item_id, ts`` from any source. Each
    stage's result is written once to the shared checkpoint folder, so
    later stages and training read files, not recomputed lineage.
    """
    runtime = runtime or RuntimeConfig()
    stats: dict[str, float] = {}
    t_all = time.time()
    n = runtime.num_partitions

    # load + dedup in one job: raw rows are never written themselves; each
    # pair keeps its repeat count, so raw = sum of counts, read from the
    # written table (exact even when a lost executor makes a stage rerun). The
    # published stats name both steps: the write is the load, the count of
    # raw rows from the pairs is the dedup
    t = time.time()
    _stage(interactions, "load+dedup")
    stats["num_partitions"] = n or default_partitions(interactions.sparkSession)
    pairs = interactions.groupBy("user_id", "item_id").agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("_repeats"))
    pairs, n_dedup = materialize(pairs, "dedup", count=True)
    stats["load_seconds"] = time.time() - t
    stats["raw_interactions"] = int(pairs.agg(F.sum("_repeats")).first()[0] or 0)
    stats["deduped_interactions"] = n_dedup
    dedup = pairs.select("user_id", "item_id", "ts")
    stats["dedupe_seconds"] = time.time() - t - stats["load_seconds"]
    stats["load_dedup_seconds"] = time.time() - t

    t = time.time()
    _stage(interactions, "k-core")
    kc = k_core(dedup, model.min_user_interactions, model.min_item_interactions,
                max_rounds=runtime.max_kcore_rounds, input_count=n_dedup)
    stats["filtered_interactions"] = kc.counts[-1]
    stats["kcore_rounds"] = kc.rounds
    stats["kcore_seconds"] = time.time() - t

    t = time.time()
    _stage(interactions, "index")
    ix = index_interactions(kc.interactions, n)
    user_index, item_index = ix.user_index, ix.item_index
    num_users, num_items = ix.num_users, ix.num_items
    indexed, n_indexed = materialize(ix.interactions, "indexed", count=True)
    release(pairs)
    release(kc.interactions)
    stats["num_users"] = num_users
    stats["num_items"] = num_items
    stats["indexed_interactions"] = n_indexed
    stats["index_seconds"] = time.time() - t

    t = time.time()
    _stage(interactions, "split")
    # the test table is written first and reused by the train anti join
    test, n_test = materialize(leave_one_out(indexed).test, "test", count=True)
    train, n_train = materialize(train_without_test(indexed, test), "train", count=True)
    stats["train_interactions"] = n_train
    stats["test_users"] = n_test
    stats["split_seconds"] = time.time() - t

    t = time.time()
    _stage(interactions, "weights")
    counts, _ = materialize(item_popularity(train), "item_counts")
    weights, n_weighted = materialize(weights_from_counts(counts, model.c0, model.alpha),
                                      "weights", count=True)
    stats["weighted_items"] = n_weighted
    stats["weights_seconds"] = time.time() - t

    t = time.time()
    _stage(interactions, "histories")
    hist, n_hist = materialize(histories(train, weights), "hist", count=True)
    if n_hist != n_train:  # the weight join is lossless by construction
        raise RuntimeError(f"history has {n_hist} rows, train has {n_train}")
    # every train row has a weight (weights come from train), so the users
    # with a history are the test users with train rows and the items with a
    # history are the weighted items: no distinct count over the history
    stats["user_histories"] = int(test.filter(F.col("n_train") > 0).count())
    stats["item_histories"] = n_weighted
    stats["history_seconds"] = time.time() - t
    # ids are never collected: they stay the index tables
    stats["collect_ids_seconds"] = 0.0
    release(counts)
    stats["total_prepare_seconds"] = time.time() - t_all
    interactions.sparkSession.sparkContext.setJobDescription(None)

    return Prepared(num_users, num_items, user_index, item_index, indexed, train, test,
                    weights, hist, stats)
