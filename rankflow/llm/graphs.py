"""Connected components of a table of edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rankflow.llm.common import written


#: Edges for each task that writes them, about.
TASK_EDGES = 50_000


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written to the shared folder, and their number and hash sum, counted on the way."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
    return out, (seen.get["n"], seen.get["sum"])


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _with_least(edges: DataFrame, parts: int) -> DataFrame:
    """a, b, m: the least of a and its neighbours b. The edges of a node are dealt to `parts` tasks by b."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)))
    least = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("a", F.min("m").over(Window.partitionBy("a"))))  # `parts` rows of a node at most
    return dealt.join(least, ["a", "part"]).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, label (its component's least node), for each node of the edges (a, b: long); edges of a node to itself
    make it a component of its own. The result is a table in the shared folder.

    Alternating star contraction: each node's larger neighbours, then its smaller ones, are tied to the least of its
    neighbourhood, until nothing changes; about log(nodes) rounds, each written to the shared folder. The edges of one
    node are dealt to as many tasks as the square root of all edges, so that none reads more than about that many of
    them, and a node that holds a third of all edges is no bottleneck."""
    edges, now = _observed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    alone, edges, before = edges.where("a = b").select("a"), edges.where("a > b"), None
    while now != before:
        before, tasks, parts = now, 1 + now[0] // TASK_EDGES, 1 + math.isqrt(2 * now[0])
        large = _with_least(edges.unionByName(_turned(edges)), parts).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.coalesce(tasks))
        small = _with_least(large, parts).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges, now = _observed(small.where("a <> b").distinct().coalesce(tasks))
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node")).unionByName(alone.select(F.col("a").alias("node")))
    return written(stars.unionByName(roots.withColumn("label", F.col("node"))).groupBy("node").agg(F.min("label").alias("label")))
