"""Running sums within a group, cut into pieces of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def running_sum(df: DataFrame, group: str, position: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Sum of value up to and including the row's position within its group.

    Rows that share a position share the sum (RANGE frame). The integer position is
    cut into chunks: the window runs inside (group, chunk), and the few chunk totals
    get their own running sum, so a very long group is spread over many tasks.
    """
    df = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)))
    inside = Window.partitionBy(group, "_chunk").orderBy(position)
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(group, "_chunk").agg(F.sum(value).alias("_total"))
        .withColumn("_offset", F.sum("_total").over(before))
        .filter(F.col("_offset").isNotNull())
        .select(group, "_chunk", "_offset")
    )
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [group, "_chunk"], "left")
        .withColumn(out, F.coalesce("_offset", F.lit(0.0)) + F.col("_inside"))
        .drop("_chunk", "_inside", "_offset")
    )
