"""Id -> index joins that survive hot ids.

A shuffle join sends all rows of an id to one task. A frequent-items sketch
(Spark's mergeable ``approx_top_k``, filled per task and merged) names the ids
that hold more than their share of the rows. There are at most ``_MOST`` of
them, so their index rows are broadcast and their interactions stay where
they are read; all other interactions meet their index row by a shuffle. The
sketch only chooses the way, so its error never changes the result.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import default_partitions

_MOST = 256        # hot ids of a side at most: bound of what is broadcast
_TRACKED = 10_000  # entries of the sketch


def hot_ids(df: DataFrame, keys: list[str], share: float | None = None) -> dict[str, list]:
    """Per column of ``keys`` the ids (at most ``_MOST``) that hold more than ``share``
    of the rows, by default half of what a shuffle partition holds; one scan."""
    if share is None:
        share = 1 / (2 * default_partitions(df.sparkSession))
    tops = [F.expr(f"approx_top_k(`{k}`, {_MOST}, {_TRACKED})").alias(k) for k in keys]
    found = df.agg(F.count(F.lit(1)).alias("_rows"), *tops).first()
    return {k: [top["item"] for top in found[k] or []
                if top["item"] is not None and top["count"] > share * found["_rows"]]
            for k in keys}


def lookup(df: DataFrame, indexes: dict[str, DataFrame], share: float | None = None) -> DataFrame:
    """``df`` joined with ``indexes[key]`` on every ``key`` (inner). A row takes the
    broadcast for each of its keys that is hot and the shuffle for the others."""
    hot = hot_ids(df, list(indexes), share)
    parts = []
    for ways in product(*[(False, True) if hot[k] else (False,) for k in indexes]):
        part = df
        for key, is_hot in zip(indexes, ways):
            if hot[key]:
                inside = F.col(key).isin(hot[key])
                part = part.filter(inside if is_hot else ~inside)
        # broadcast joins first: they move no rows
        for key, is_hot in sorted(zip(indexes, ways), key=lambda way: not way[1]):
            index = indexes[key]
            if is_hot:
                index = F.broadcast(index.filter(F.col(key).isin(hot[key])))
            part = part.join(index, key)
        parts.append(part.select(*df.columns, *[c for k, index in indexes.items()
                                                for c in index.columns if c != k]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
