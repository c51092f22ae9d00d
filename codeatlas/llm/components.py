"""Connected components of an edge table, all in DataFrames.

Alternates large-star and small-star steps, which contract every component to a
star around its smallest node in a number of rounds logarithmic in its size.
Minima are combined before their shuffle, and a hot centre meets its edges in a
join of stored tables that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, written


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v): each v goes to the smallest of u and u's neighbours."""
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-minima")
    return edges.join(least, "u")


def _print(edges: DataFrame) -> tuple:
    """Count and hash sum, which tell whether a table of distinct edges has changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Nulls and loops are ignored.  Nodes without an edge to another have no row.
    """
    spark = edges.sparkSession
    with scratch() as made:
        pair = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
        before = _print(pair)
        for _ in range(rounds):
            both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
            star = _star(both)
            ups = star.filter("v > u and m < v").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = written(ups.unionByName(star.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), "edges-large")
            small = _star(large)
            moved = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            pair = written(moved.distinct(), "edges")
            after = _print(pair)
            discard(spark, made[:-1])  # only the last table is read from here on
            del made[:-1]
            if after == before:
                return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                    pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
                )
            before = after
    raise RuntimeError("components did not settle")
