"""Factor tables: initialization (M2), Gram matrices (A9, A10), formats.

A factor table is ``idx BIGINT, vec ARRAY<FLOAT|DOUBLE>``, one row per user
or item, distributed. Only the K x K Gram matrices reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_normal


def vec_type(dtype: str) -> T.ArrayType:
    return T.ArrayType(T.FloatType() if dtype == "float32" else T.DoubleType())


def init_factors(ids: DataFrame, idx_col: str, factors: int, seed: int, tag: str,
                 mean: float = 0.0, std: float = 0.01, dtype: str = "float32") -> DataFrame:
    """M2: ``vec[f] ~ N(mean, std)``, a pure function of (seed, tag, idx, f).

    No shuffle and no driver matrix; the same table comes out for any
    partitioning or number of executors.
    """
    vec = F.transform(F.sequence(F.lit(0), F.lit(factors - 1)),
                      lambda f: hash_normal(seed, tag, F.col(idx_col), f, mean, std))
    return ids.select(F.col(idx_col).cast("bigint").alias("idx"),
                      vec.cast(vec_type(dtype)).alias("vec"))


def factors_long(factors: DataFrame) -> DataFrame:
    """``idx, f, v`` rows (one per coordinate) for inspection and SQL checks."""
    return factors.select("idx", F.posexplode("vec").alias("f", "v")).select(
        "idx", F.col("f").cast("bigint").alias("f"), F.col("v").cast("double").alias("v"))


_GRAM_SCHEMA = T.StructType([
    T.StructField("f", T.IntegerType()), T.StructField("g", T.IntegerType()),
    T.StructField("v", T.DoubleType())])


def _partial_gram(factors: int):
    iu, ju = np.triu_indices(factors)

    def run(batches):
        acc = np.zeros((factors, factors))
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.vstack(pdf["vec"].to_numpy()).astype(np.float64)
            w = pdf["w"].to_numpy(dtype=np.float64)
            acc += x.T @ (x * w[:, None])
            seen = True
        if seen:
            yield pd.DataFrame({"f": iu.astype(np.int32), "g": ju.astype(np.int32),
                                "v": acc[iu, ju]})
    return run


def _weighted(factors: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return factors.select("vec", F.lit(1.0).alias("w"))
    return (factors.join(weights.select(F.col("item_idx").alias("idx"), "c"), "idx", "left")
            .select("vec", F.coalesce("c", F.lit(0.0)).alias("w")))


def gram_table(factors: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
    """A9/A10 as a frame ``f, g, v``: ``sum_i w_i x_i x_i^T`` in float64.

    Each task folds its rows into one K x K partial (upper triangle emitted),
    then a K(K+1)/2-key sum combines the partials; rows without a weight
    count 0 (items unseen in train).
    """
    upper = (_weighted(factors, weights).mapInPandas(_partial_gram(k), _GRAM_SCHEMA)
             .groupBy("f", "g").agg(F.sum("v").alias("v")))
    # the lower triangle mirrors the upper one
    both = F.when(F.col("f") == F.col("g"), F.array(F.struct("f", "g"))).otherwise(
        F.array(F.struct("f", "g"), F.struct(F.col("g").alias("f"), F.col("f").alias("g"))))
    return upper.select(F.explode(both).alias("at"), "v").select("at.f", "at.g", "v")


def gram_matrix(factors: DataFrame, k: int, weights: DataFrame | None = None) -> np.ndarray:
    """``gram_table`` as a K x K matrix on the driver (K^2 doubles: bounded by K)."""
    s = np.zeros((k, k))
    for row in gram_table(factors, k, weights).collect():
        s[row["f"], row["g"]] = row["v"]
    return s
