"""Committed, versioned tables on a shared store (S4, and the state of I2).

A version is a folder of Parquet tables plus a manifest, which is written last:
a folder without one was left by a writer that did not finish; it is never read,
and the next writer removes it. Versions are numbered; readers take the newest
committed one, so a reader and a writer never meet in one folder.
"""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from ..config import ModelConfig
from .prepare import Prepared

FORMAT = 1
_MANIFEST = "manifest.json"
_PREPARED_TABLES = ("user_index", "item_index", "indexed", "train", "test", "weights", "hist")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """Version -> whether it is committed."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return {int(n[2:]): fs.exists(_fs(spark, f"{path}/{n}/{_MANIFEST}")[1])
            for n in names if n.startswith("v-") and n[2:].isdigit()}


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v-{version:08d}"


def newest(spark: SparkSession, path: str) -> int | None:
    done = [v for v, committed in _versions(spark, path).items() if committed]
    return max(done, default=None)


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict,
           keep: int | None = None) -> int:
    """Write ``tables`` as a new version and then its manifest; returns the
    version. Unfinished folders go first; afterwards all but the ``keep`` newest
    committed versions go (None keeps all). One writer at a time."""
    path = path.rstrip("/")
    seen = _versions(spark, path)
    for version, committed in seen.items():
        if not committed:
            _remove(spark, _folder(path, version))
    version = max(seen, default=0) + 1
    folder = _folder(path, version)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    fs, target = _fs(spark, f"{folder}/{_MANIFEST}")
    out = fs.create(target, False)  # visible when it is closed
    out.write(bytearray(json.dumps({"format": FORMAT, "tables": sorted(tables), **meta}).encode()))
    out.close()
    if keep is not None:
        done = sorted(v for v, committed in seen.items() if committed) + [version]
        for old in done[:-keep]:
            _remove(spark, _folder(path, old))
    return version


def _remove(spark: SparkSession, folder: str) -> None:
    fs, target = _fs(spark, folder)
    fs.delete(target, True)


def load(spark: SparkSession, path: str, version: int | None = None
         ) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest of a committed version (the newest by default)."""
    path = path.rstrip("/")
    version = newest(spark, path) if version is None else version
    if version is None or not _versions(spark, path).get(version):
        raise FileNotFoundError(f"no committed version under {path}")
    folder = _folder(path, version)
    meta = json.loads(spark.read.text(f"{folder}/{_MANIFEST}", wholetext=True).first()[0])
    if meta["format"] != FORMAT:
        raise ValueError(f"{folder} has format {meta['format']}, this library reads {FORMAT}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]}, meta


def save_prepared(prep: Prepared, path: str) -> int:
    """The whole prepared set (index, train, test, weights, histories)."""
    spark = prep.train.sparkSession
    return commit(spark, path, {name: getattr(prep, name) for name in _PREPARED_TABLES},
                  {"num_users": prep.num_users, "num_items": prep.num_items, "stats": prep.stats})


def load_prepared(spark: SparkSession, path: str, version: int | None = None) -> Prepared:
    """A saved prepared set, as ``prepare`` returned it."""
    tables, meta = load(spark, path, version)
    named = {f.name for f in fields(Prepared)}
    return Prepared(num_users=meta["num_users"], num_items=meta["num_items"], stats=meta["stats"],
                    **{name: df for name, df in tables.items() if name in named})


def _fingerprint(prep: Prepared, model: ModelConfig) -> dict:
    """What a training state belongs to (the number of iterations may change)."""
    config = json.loads(model.to_json())
    for free in ("iterations", "topk"):
        config.pop(free)
    return {"model": config, "num_users": prep.num_users, "num_items": prep.num_items,
            "train": prep.stats.get("train_interactions")}


def save_iteration(path: str, prep: Prepared, model: ModelConfig, p: DataFrame, q: DataFrame,
                   log: list) -> tuple[DataFrame, DataFrame]:
    """Commit the factors after an iteration; returns them read back. The
    version before stays until the next commit, as readers may hold it."""
    spark = p.sparkSession
    version = commit(spark, path, {"p": p, "q": q},
                     {"log": log, "of": _fingerprint(prep, model)}, keep=2)
    tables, _ = load(spark, path, version)
    return tables["p"], tables["q"]


def load_iteration(path: str, prep: Prepared, model: ModelConfig):
    """(p, q, log) of the newest committed iteration, or None. A state of other
    data or another model is an error, not a silent fresh start."""
    spark = prep.train.sparkSession
    if newest(spark, path) is None:
        return None
    tables, meta = load(spark, path)
    if meta["of"] != _fingerprint(prep, model):
        raise ValueError(f"the training state under {path} belongs to other data or settings")
    return tables["p"], tables["q"], meta["log"]
