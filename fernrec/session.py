"""Session helpers: shared checkpoint folder, lineage cuts, scratch tables.

Iterative jobs (k-core rounds, training half-steps) cut their lineage by
writing a Parquet table into the folder the cluster names in
``spark.checkpoint.dir`` and reading it back. A written table survives the
loss of any executor, keeps file statistics for AQE and is read column-pruned.
A machine-local folder is only created when Spark runs in local mode and no
folder is configured (tests, the bench).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app: str = "fernrec") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts; set a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fernrec-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set: iterative jobs need a shared folder "
        "(HDFS/S3/ABFS) to cut lineage; a machine-local folder does not survive "
        "executor loss")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fernrec/{uuid.uuid4().hex}/{name}"


def _observed_rows(obs: Observation, written: DataFrame) -> int:
    """Row count observed in the write job; when no task of the job ran (an
    input without partitions gives an empty metrics row), count the files."""
    try:
        value = obs.get.get("n")
    except Exception:  # noqa: BLE001 - empty observation row
        value = None
    return int(value) if value is not None else written.count()


def materialize(df: DataFrame, name: str = "table",
                count: bool = False) -> tuple[DataFrame, int | None]:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage (the returned frame depends on files only) and, when
    ``count`` is set, returns the row count observed in the same write job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if count:
        obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
        df.observe(obs, F.count(F.lit(1)).alias("n")).write.parquet(path)
        out = _with_place(_read_back(df, path), path)
        return out, _observed_rows(obs, out)
    df.write.parquet(path)
    return _with_place(_read_back(df, path), path), None


def _read_back(df: DataFrame, path: str) -> DataFrame:
    """The written ``df``; its schema is known, so no job reads file footers."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, name: str, *sums,
                         bucket_by: str | None = None) -> tuple[DataFrame, list]:
    """As ``materialize``, with aggregates of the written rows, integers (0 for
    no rows) or lists, observed in the same job. With ``bucket_by`` the table is
    bucketed by that column, a bucket per shuffle partition."""
    spark = df.sparkSession
    obs = Observation(f"sums_{uuid.uuid4().hex[:8]}")
    named = [e.alias(f"v{k}") for k, e in enumerate(sums)]
    path = scratch_path(spark, name)
    if bucket_by:
        n, table = default_partitions(spark), f"fernrec_{name}_{uuid.uuid4().hex[:12]}"
        (df.repartition(n, bucket_by).observe(obs, *named).write.bucketBy(n, bucket_by)
         .option("path", path).saveAsTable(table))
        out = _with_place(spark.table(table), path, table)
    else:
        df.observe(obs, *named).write.parquet(path)
        out = _with_place(_read_back(df, path), path)
    try:
        seen = obs.get
    except Exception:  # noqa: BLE001 - no task ran: an empty observation row
        seen = out.agg(*named).first().asDict()
    values = [seen.get(f"v{k}") for k in range(len(sums))]
    return out, [v if isinstance(v, list) else int(v or 0) for v in values]


def write_partitioned(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` in one folder per value of ``key`` and read it back: a
    filter on ``key`` reads only those folders. ``df`` must not be empty."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(key).parquet(path)
    return _with_place(_read_back(df, path), path)


def _with_place(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """``df`` that remembers the scratch folder (and catalog table) behind it."""
    df._scratch = (path, table)
    return df


def materialize_bucketed(df: DataFrame, name: str, key: str,
                         buckets: int) -> tuple[DataFrame, int]:
    """Write ``df`` as a table bucketed by ``key`` under the checkpoint folder.

    Reading it back reports hash partitioning on ``key``, so a later
    group/cogroup/join on ``key`` shuffles only the other side: a static
    table reused every iteration is moved once, not once per iteration.
    Returns the frame and its row count.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"fernrec_{name}_{uuid.uuid4().hex[:12]}"
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    # observed after the exchange: counted in the write (result) stage only
    (df.repartition(buckets, key).observe(obs, F.count(F.lit(1)).alias("n"))
     .write.bucketBy(buckets, key).option("path", path).saveAsTable(table))
    out = _with_place(spark.table(table), path, table)
    return out, _observed_rows(obs, out)


def release(df: DataFrame | None) -> None:
    """Delete the scratch files (and catalog table) behind a frame returned by
    ``materialize`` or ``materialize_bucketed``; other frames are left alone."""
    path, table = getattr(df, "_scratch", (None, None))
    if path is None:
        return
    spark = df.sparkSession
    if table is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    df._scratch = (None, None)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
