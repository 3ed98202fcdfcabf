"""Connected components of a link table, by distributed union-find.

Each phase hooks every node to its smallest neighbour if that is smaller
(partial minima, so a hub costs no more than its links spread over the
tasks), halves the pointer paths until all point at roots, and contracts the
links to links between roots. Every phase at least halves the roots that
still have links. All tables are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written, written_counted


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest
    node of its component. Loops and repeated links do no harm."""
    return extend_components(None, links)


def extend_components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root) after adding ``links`` (a, b) to those of
    ``roots``; the work follows the new links."""
    links, left = written_counted(_between_roots(roots, links), "links")
    if roots is None and not left:
        kind = links.schema["a"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    while left:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parents = written(both.groupBy("node").agg(F.min("to").alias("to"))
                          .select("node", F.least("node", "to").alias("root")), "parents")
        # nodes that do not yet point at a root
        moving = 1
        while moving:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            far = parents.filter(F.col("node") != F.col("root")).join(up, "root").filter(
                F.col("_up") != F.col("root")).select("node", F.col("_up").alias("_to"))
            far, moving = written_counted(far, "pointers")
            if moving:
                parents = written(parents.join(far, "node", "left").select(
                    "node", F.coalesce("_to", "root").alias("root")), "parents")
        if roots is None:
            roots = parents
        else:
            # known nodes follow their root; nodes new to the table are added
            higher = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            moved = roots.join(higher, "root", "left").select(
                "node", F.coalesce("_up", "root").alias("root"))
            roots = written(moved.unionByName(parents.join(roots, "node", "left_anti")), "roots")
        links, left = written_counted(_between_roots(roots, links), "links")
    return roots


def _between_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``links`` with their ends replaced by the ends' roots, loops left out."""
    if roots is not None:
        for end in ("a", "b"):
            links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("_r")),
                               end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    return (links.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
