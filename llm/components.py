"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage

MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node of the component) for all nodes of edges (a, b); longs.

    In every round each node points at its smallest neighbour, if that is smaller. The pointers are doubled until all
    end at a node that points nowhere, and the graph is contracted to those, of which there are half as many at most.
    So a chain of any length takes logarithmically many steps, and a hub's edges collapse to one row before the shuffle
    by node. Tables are written between steps; nothing but whether work is left reaches the driver. Null ends and loops
    are ignored, repeated edges count once; no edges give an empty table."""
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = stage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    for _ in range(MOST_ROUNDS):
        if e.isEmpty():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = stage(near.select("node", F.least("node", "low").alias("parent")))
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            moved = stage(parent.join(up, "parent").select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")))
            parent = moved.select("node", "parent")
            if moved.filter("moved").isEmpty():
                break
        steps.append(parent)
        to = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}"))
        e = stage(e.join(to("a"), "a").join(to("b"), "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    else:
        if not e.isEmpty():
            raise RuntimeError("components did not settle")
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    labels = steps[-1].withColumnRenamed("parent", "component")
    for parent in reversed(steps[:-1]):
        known = labels.select(F.col("node").alias("parent"), "component")
        labels = parent.join(known, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
        labels = stage(labels)
    return labels
