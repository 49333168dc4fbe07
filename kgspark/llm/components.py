"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import checkpoint

#: Edges to a partition: each round shuffles several times, and every task of a shuffle leaves files, however few its rows.
EDGES = 1 << 14


def _towards_smallest(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step over edges (a, b) with b < a.

    Large: every node ties its larger neighbours to the smallest node it knows. Small: every node ties its
    smaller neighbours and itself to the smallest of them. A hub's rows meet in a join that Spark can split;
    the minimum itself is an aggregate with a map-side part. Rows that are shuffled next come in at most parts partitions.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = tied.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Nodes without an edge to another node, and edges with a null end, do not appear. Each round is written to
    the shared checkpoint folder; the rounds end when a round changes nothing. No step makes more edges than it gets,
    so the first number of edges says for all rounds how many partitions they need.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpoint(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = mark(now)
    parts = max(1, math.ceil(seen[0] / EDGES))
    now = now.coalesce(parts)
    while seen[0]:
        now = checkpoint(_towards_smallest(_towards_smallest(now, True, parts), False, parts))
        if (then := mark(now)) == seen:
            break
        seen = then
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
