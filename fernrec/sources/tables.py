"""Interaction adapters for any table: pick user, item and time columns.

Ids are cast to STRING (the dense index orders by string id, as the text
source does) and times become BIGINT microseconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import epoch_micros


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def interactions_from_table(df: DataFrame, user: Column | str, item: Column | str,
                            ts: Column | str) -> DataFrame:
    """Project ``user_id STRING, item_id STRING, ts BIGINT`` from any frame.

    ``ts`` may be an integer column (taken as is) or a timestamp (epoch
    microseconds). Rows with a NULL in any of the three are dropped.
    """
    u = F.col(user) if isinstance(user, str) else user
    i = F.col(item) if isinstance(item, str) else item
    t = F.col(ts) if isinstance(ts, str) else ts
    out = df.select(u.cast("string").alias("user_id"), i.cast("string").alias("item_id"),
                    t.alias("ts"))
    ts_type = out.schema["ts"].dataType.typeName()
    if ts_type.startswith("timestamp") or ts_type == "date":
        out = out.withColumn("ts", epoch_micros("ts"))
    else:
        out = out.withColumn("ts", F.col("ts").cast("bigint"))
    return out.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()
                      & F.col("ts").isNotNull())


def events_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV: ``events`` as (user_id, props $.k, ts)."""
    ev = spark.read.parquet(table_path(sf_dir, "events"))
    return interactions_from_table(ev, "user_id", F.get_json_object("props", "$.k"), "ts")


def order_line_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OL: ``orders JOIN lineitem`` as (o_custkey, l_partkey, o_orderdate)."""
    orders = spark.read.parquet(table_path(sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderdate")
    lines = spark.read.parquet(table_path(sf_dir, "lineitem")).select("l_orderkey", "l_partkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return interactions_from_table(joined, "o_custkey", "l_partkey", "o_orderdate")
