"""Model and runtime settings as one validated, frozen dataclass each."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class ModelConfig:
    """Hyper-parameters of element-wise ALS with popularity-weighted missing data.

    Defaults are the paper settings used for the published full run.
    """

    factors: int = 128
    reg_lambda: float = 0.01
    c0: float = 64.0
    alpha: float = 0.5
    observed_weight: float = 1.0
    observed_value: float = 1.0
    iterations: int = 100
    topk: int = 100
    min_user_interactions: int = 10
    min_item_interactions: int = 10
    init_mean: float = 0.0
    init_std: float = 0.01
    random_seed: int = 42
    dtype: str = "float32"

    def __post_init__(self) -> None:
        if self.factors < 1:
            raise ValueError("factors must be >= 1")
        if not self.reg_lambda > 0:
            raise ValueError("reg_lambda must be > 0 (a zero vector would divide by zero)")
        if self.c0 < 0 or self.observed_weight < 0:
            raise ValueError("c0 and observed_weight must be >= 0")
        if self.iterations < 0:
            raise ValueError("iterations must be >= 0")
        if self.topk < 0:
            raise ValueError("topk must be >= 0")
        if self.min_user_interactions < 0 or self.min_item_interactions < 0:
            raise ValueError("k-core thresholds must be >= 0")
        if self.init_std < 0:
            raise ValueError("init_std must be >= 0")
        if self.dtype not in ("float32", "float64"):
            raise ValueError("dtype must be 'float32' or 'float64'")

    def with_(self, **changes) -> "ModelConfig":
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class RuntimeConfig:
    """Execution knobs. None means: let Spark (AQE) decide."""

    mode: str = "full"
    smoke_records: int = 10_000
    num_partitions: int | None = None
    # Interactions routed to one coordinate-update task (sizes the user/item blocks).
    # (bounds a task's memory: rows plus at most one routed vector per row)
    rows_per_block: int = 250_000
    # Entities with more interactions than this are solved from partial Gram sums
    # aggregated across many tasks instead of inside one block.
    heavy_threshold: int = 100_000
    # Rows of one heavy entity folded into one partial-sum task.
    heavy_chunk_rows: int = 50_000
    # Users x items scored in one evaluation task, and the maximum rows per side.
    eval_block_users: int = 4096
    eval_block_items: int = 8192
    eval_user_sample: int | None = None
    # None: to the fixpoint; a limit that runs out raises
    max_kcore_rounds: int | None = None

    def __post_init__(self) -> None:
        # exact, case-sensitive: "SMOKE" must not silently run the full file
        if self.mode not in ("full", "smoke"):
            raise ValueError("mode must be exactly 'full' or 'smoke'")
        if self.num_partitions is not None and self.num_partitions < 1:
            raise ValueError("num_partitions must be a positive integer")
        if self.max_kcore_rounds is not None and self.max_kcore_rounds < 1:
            raise ValueError("max_kcore_rounds must be >= 1 or None")
        for name in ("rows_per_block", "heavy_threshold", "heavy_chunk_rows", "eval_block_users",
                     "eval_block_items", "smoke_records"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be >= 1")

    def with_(self, **changes) -> "RuntimeConfig":
        return replace(self, **changes)
