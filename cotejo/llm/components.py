"""Connected components by contraction, over edges of any shape, in Spark joins only.

Each round hooks every node to the smallest of itself and its neighbours,
follows the hooks to their ends by doubling, and replaces the ends of all edges.
A node with an edge always merges with another, so the nodes that still have
edges at least halve: rounds follow the logarithm of the largest component.
Every step is a grouped minimum or a join with a unique side, so a node with
very many edges needs no task of its own; every table is written to the shared
folder, so nothing is recomputed from the start if an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _ends(hooks: DataFrame) -> DataFrame:
    """Each node with the end of its chain of hooks."""
    while True:
        on = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("_end"))
        hooks = written(hooks.join(on, "parent").select("node", F.col("_end").alias("parent"), (F.col("_end") != F.col("parent")).alias("_moved")), "hooks")
        if hooks.filter("_moved").isEmpty():
            return hooks.drop("_moved")
        hooks = hooks.drop("_moved")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node that it reaches."""
    edges = written(edges.select("a", "b").filter("a != b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        hooks = _ends(written(hooks.select("node", F.least("node", "_least").alias("parent")), "hooks"))
        rounds.append(hooks)
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(end), F.col("parent").alias("_to")), end).withColumn(end, F.col("_to")).drop("_to")
        edges = written(edges.select("a", "b").filter("a != b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[0].withColumnRenamed("parent", "label")
    for hooks in rounds[1:]:
        on = hooks.select(F.col("node").alias("label"), "parent")
        labels = labels.join(on, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
    return labels
