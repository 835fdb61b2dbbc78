"""Connected components of a link table, as DataFrame joins and aggregations with written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm._store import drop, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the star contraction: neighbours of a node are linked to its smallest neighbour instead."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        return linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    up = linked.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """(id, component): each node of ``edges`` (a, b; longs) with the smallest id that it reaches.

    Large-star and small-star steps alternate until the links are stars around the smallest ids. Each round is a
    written stage, so the plan does not grow; minima are pre-aggregated and the joins may be split where a node is hot.
    Nodes without links are absent. Self-links and repeated links change nothing; an empty table gives an empty one.
    """
    now = stage(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a != b").distinct(), folder, f"{name}-0")
    before, step = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, step = mark, step + 1
        nxt = stage(_star(_star(now, True), False), folder, f"{name}-{step}")
        drop(edges.sparkSession, folder, f"{name}-{step - 1}")
        now = nxt
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
