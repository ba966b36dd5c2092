"""Distributed connected components by alternating large-star and small-star steps.

Edges stay in Spark: each step joins the edges with the least neighbour of every
node, both read from staged tables, so that a hot node's edges can be split over
tasks at run time, and the least neighbours are pre-aggregated before they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import drop_staged, staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above u moves to the least of u and its neighbours."""
    sym = _both_ways(edges)
    least = staged(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    moved = sym.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour not above u, and u itself, move to the least of them.
    ``edges`` has u > v."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = moved.filter(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return kept.distinct(), least


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node above others has one edge, to a node above none: then each edge
    leads to the least node of its component. ``edges`` has u > v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("over"), F.lit(0).alias("under")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("over"), F.lit(1).alias("under")))
    nodes = ends.groupBy("x").agg(F.sum("over").alias("over"), F.max("under").alias("under"))
    return nodes.filter("over > 1 OR (over = 1 AND under = 1)").agg(F.count("*")).first()[0] == 0


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another one; component
    is the smallest node reachable, itself included. Null ends are ignored."""
    now = staged(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    while not _all_stars(now):
        large, least1 = _large_star(now)
        large = staged(large, "cc-edges")
        small, least2 = _small_star(large)
        then = staged(small, "cc-edges")
        drop_staged(now, large, least1, least2)
        now = then
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def local_roots(n: int, left, right) -> list[int]:
    """Union-find inside a block: for 0..n-1 the least index linked to each."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left, right):
        x, y = find(int(x)), find(int(y))
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]
