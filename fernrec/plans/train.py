"""The alternating training loop (driver loop over distributed half-steps)."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config import ModelConfig, RuntimeConfig
from ..operators.factors import gram_matrix, init_factors
from ..operators.halfstep import SideLayout, build_layout, half_step, release_layout
from ..session import materialize, release
from .prepare import Prepared
from .store import load_iteration, save_iteration


@dataclass
class Model:
    """Factor tables (``idx, vec``) and the per-iteration log."""

    p: DataFrame
    q: DataFrame
    train_log: list = field(default_factory=list)

    def log_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(int(r["iteration"]), float(r["seconds"]))
                                      for r in self.train_log], "iteration int, seconds double")


def initial_factors(prep: Prepared, model: ModelConfig) -> tuple[DataFrame, DataFrame]:
    p = init_factors(prep.user_index, "user_idx", model.factors, model.random_seed, "user",
                     model.init_mean, model.init_std, model.dtype)
    q = init_factors(prep.item_index, "item_idx", model.factors, model.random_seed, "item",
                     model.init_mean, model.init_std, model.dtype)
    return p, q


def layouts(prep: Prepared, runtime: RuntimeConfig) -> tuple[SideLayout, SideLayout]:
    users = build_layout(prep.hist, "user", runtime.heavy_threshold, runtime.rows_per_block,
                         heavy_chunk_rows=runtime.heavy_chunk_rows, num_entities=prep.num_users)
    items = build_layout(prep.hist, "item", runtime.heavy_threshold, runtime.rows_per_block,
                         heavy_chunk_rows=runtime.heavy_chunk_rows, num_entities=prep.num_items)
    return users, items


def user_step(layout: SideLayout, p: DataFrame, q: DataFrame, weights: DataFrame,
              model: ModelConfig) -> DataFrame:
    sq = gram_matrix(q, model.factors, weights)
    return half_step(layout, p, q, sq, model.reg_lambda, model.observed_weight,
                     model.observed_value, model.dtype)


def item_step(layout: SideLayout, q: DataFrame, p: DataFrame, model: ModelConfig) -> DataFrame:
    sp = gram_matrix(p, model.factors)
    return half_step(layout, q, p, sp, model.reg_lambda, model.observed_weight,
                     model.observed_value, model.dtype)


def train(prep: Prepared, model: ModelConfig, runtime: RuntimeConfig | None = None,
          p: DataFrame | None = None, q: DataFrame | None = None,
          iterations: int | None = None, state: str | None = None) -> Model:
    """Per iteration: S^q -> all users, then S^p from the new P -> all items.

    Each half-step's factor table is written to the shared checkpoint folder
    (lineage stays one half-step long, any lost executor only redoes its
    tasks); the table it replaces is deleted after the write.

    With ``state``, a folder on the shared store, every finished iteration is
    committed there (``plans.store``), and a run whose driver was lost goes on
    after the newest committed one when it is started again. Given ``p`` and
    ``q`` are only used when there is none.
    """
    runtime = runtime or RuntimeConfig()
    sc = prep.train.sparkSession.sparkContext
    sc.setJobDescription("fernrec train: init + layouts")
    n_iter = model.iterations if iterations is None else iterations
    found = load_iteration(state, prep, model) if state else None
    log = []
    if found:
        p, q, log = found
    else:
        p0, q0 = initial_factors(prep, model)
        p, _ = materialize(p if p is not None else p0, "p0")
        q, _ = materialize(q if q is not None else q0, "q0")
    if len(log) >= n_iter:
        return Model(p, q, log)
    user_layout, item_layout = layouts(prep, runtime)
    try:
        for it in range(len(log) + 1, n_iter + 1):
            t = time.time()
            sc.setJobDescription(f"fernrec train: iteration {it} users")
            p_new, _ = materialize(user_step(user_layout, p, q, prep.weights, model), f"p{it}")
            release(p)
            p = p_new
            sc.setJobDescription(f"fernrec train: iteration {it} items")
            q_new, _ = materialize(item_step(item_layout, q, p, model), f"q{it}")
            release(q)
            q = q_new
            log.append({"iteration": it, "seconds": time.time() - t})
            if state:
                p_new, q_new = save_iteration(state, prep, model, p, q, log)
                release(p)
                release(q)
                p, q = p_new, q_new
    finally:
        for layout in (user_layout, item_layout):
            release_layout(layout)
        sc.setJobDescription(None)
    return Model(p, q, log)
