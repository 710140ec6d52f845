"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.session import settle


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows. One row per edge, some the same."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them. Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """One row (node, component) for each node of an edge that is not the smallest of its component.

    `component` is the smallest node reachable. Loops and edges with a NULL end are ignored, repeated edges count once;
    without edges the result is empty. Each round is written to the shared folder, so that the lineage stays short;
    the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select(
        F.greatest(first, second).alias("u"), F.least(first, second).alias("v")
    ).where(f"{first} <> {second}").distinct()
    now = settle(now, "stars")
    state = _state(now)
    while state[0]:
        after = settle(_small_star(_large_star(now)), "stars")
        before, now, state = state, after, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
