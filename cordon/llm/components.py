"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_sized, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    # of a node's edges only those to larger ones stay
    return join_sized(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_sized(edges, least, "a", "n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node that it reaches.

    ``edges`` has two columns of orderable ids; loops, repeats and nulls are left out. Each step's edges
    are written to the shared folder; the number of steps grows with the logarithm of the nodes.
    """
    a, b = edges.columns[:2]
    now = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges"
    )
    seen = _print(now)
    while seen[0]:
        large = written(_large_star(now, seen[0]), "edges")
        step = written(_small_star(large, 2 * seen[0]), "edges")
        drop_written(now.sparkSession, now, large)
        now, before, seen = step, seen, _print(step)
        if seen == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
