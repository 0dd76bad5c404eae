"""Connected components of a graph held in a DataFrame, by alternating large and small stars.

Every round is a handful of shuffles on node keys; minima are aggregated map-side, and they are staged before they
are joined back, so that both sides of that join have their own exchange and AQE can split a hub's rows. Nothing but
two numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from haulmark.llm._common import mark, remove_since, staged, staged_at

FEW = 100_000


def _roots(edges: list[tuple]) -> list[tuple]:
    """Union-find over (larger, smaller): (node, root) of each node."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    order = lambda x: tuple((y is not None, y) for y in (x if isinstance(x, tuple) else (x,)))
    for a, b in edges:
        a, b = sorted((root(a), root(b)), key=order)
        parent[b] = a
    return [(x, root(x)) for x in list(parent)]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = down.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any one orderable type -> (node, root), a row for every node that has an edge to another node;
    root is the component's smallest node. Loops and repeated edges do no harm; no edges give no rows."""
    spark, start = edges.sparkSession, mark(edges.sparkSession)
    now, at = staged_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    if state[0] <= FEW:
        kind = now.schema["a"].dataType
        found = spark.createDataFrame(_roots(now.collect()), StructType([StructField("node", kind), StructField("root", kind)]))
        remove_since(spark, start)
        return found
    while state[0]:
        now, at = staged_at(_small(staged(_large(now), "large")), "small")
        remove_since(spark, start, (at,))  # a round needs nothing but what the last one left
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
