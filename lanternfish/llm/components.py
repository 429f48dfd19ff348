"""Connected components of an edge table by repeated contraction.

Each round sends every node to its smallest neighbour, follows those pointers a
step, and replaces the edges' ends by where they lead; edges inside one component
vanish, so the tables shrink.  Nothing is collected: the driver only learns
whether edges are left.

All pointers of a large component lead to one root.  Pointers are therefore written
before they are joined: then both sides of a join are plain shuffles, and adaptive
execution can split the root's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame, what: str = "edges") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable."""
    left = store.cut(edges.where("a <> b").select("a", "b").distinct(), what)
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = store.cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), what)
        down = store.cut(first.join(first.select(F.col("a").alias("at"), F.col("low").alias("lower")), F.col("low") == F.col("at")).select("a", F.col("lower").alias("low")), what)
        ends = left.join(down.withColumnRenamed("low", "x"), "a").join(down.select(F.col("a").alias("b"), F.col("low").alias("y")), "b")
        left = store.cut(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), what)
        if roots is None:
            roots = down.select(F.col("a").alias("node"), F.col("low").alias("root"))
        else:
            step = down.select(F.col("a").alias("at"), "low")
            roots = roots.join(step, F.col("root") == F.col("at"), "left").select("node", F.coalesce("low", "root").alias("root"))
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else store.cut(roots, what)
