"""Connected components by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges (a, b): the smallest vertex that it can reach.

    Each round hooks every vertex to its smallest neighbour (or itself) and replaces the graph by that of the hooks;
    every vertex but the local minima goes, so the vertices at least halve and the rounds are logarithmic. Nothing is
    collected; each round's hooks are written to the shared folder. Null ends and loops are ignored.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), "hooks")
        if labels is None:
            labels = hooks.select("v", F.col("m").alias("component"))
        else:
            onward = hooks.select(F.col("v").alias("component"), F.col("m").alias("next"))
            labels = written(labels.join(onward, "component", "left").select("v", F.coalesce("next", "component").alias("component")), "labels")
        left = hooks.select(F.col("v").alias("a"), F.col("m").alias("x"))
        right = hooks.select(F.col("v").alias("b"), F.col("m").alias("y"))
        edges = edges.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        edges = written(edges, "edges")
        if edges.isEmpty():
            return labels
