"""Running totals and percent_rank over a whole table, without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _bucket(value: str, splits: str, n_splits: int) -> str:
    """How many of the sorted splits lie at or below the value, by binary search."""
    steps = max(1, math.ceil(math.log2(n_splits + 1)))
    sizes = ", ".join(str(2 ** (steps - 1 - i)) for i in range(steps))
    return (f"aggregate(array({sizes}), 0, (found, size) -> CASE WHEN try_element_at({splits}, found + size) <= {value} "
            f"THEN found + size ELSE found END)")


def prefix_by_value(df: DataFrame, column: str, measures: dict[str, Column], buckets: int = BUCKETS,
                    by: str | None = None) -> DataFrame:
    """One row per distinct value with, per measure m, m, m_before and m_total.

    ``m_before`` sums the measure over all smaller values. Equal values are combined
    first. The distinct values are cut at approximate quantiles into buckets, summed
    inside each bucket, and moved up by the buckets before; only the bucket totals, a
    fixed number of rows, go through one task. NULL comes first. ``by`` names a column
    with a few values, each of which is a table of its own.
    """
    own = [by] if by else []
    counts = df.groupBy(*own, F.col(column).alias("_v")).agg(*[m.alias(name) for name, m in measures.items()])
    probabilities = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    splits = counts.groupBy(*own).agg(F.expr(
        f"array_sort(array_distinct(percentile_approx(_v, array({probabilities}), {10 * buckets})))").alias("_splits"))
    placed = counts.join(F.broadcast(splits), by) if by else counts.withColumn("_splits", splits.scalar())
    bucketed = placed.selectExpr(
        *own, "_v", *measures,
        f"CASE WHEN _v IS NULL THEN -1 ELSE {_bucket('_v', '_splits', buckets)} END AS _b")

    inside = Window.partitionBy(*own, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*own).orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    sums = bucketed.groupBy(*own, "_b").agg(*[F.sum(m).alias(m) for m in measures])  # at most `buckets` rows each
    totals = sums.select(*own, "_b", *[c for m in measures for c in (
        F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_offset"),
        F.sum(m).over(whole).alias(f"{m}_total"))])
    joined = bucketed.withColumns({
        f"_{m}_inside": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}).join(
            F.broadcast(totals), [*own, "_b"])
    return joined.select(*own, "_v", *[c for m in measures for c in (
        F.col(m), (F.col(f"_{m}_offset") + F.col(f"_{m}_inside")).alias(f"{m}_before"), F.col(f"{m}_total"))])


def percent_ranks(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, rank_0, rank_1, ...): percent_rank() OVER (ORDER BY column) for several numeric columns in one pass.

    The columns are stacked to rows (metric, value), ranked side by side and folded back by the key, which must be
    unique in ``df``. NULL sorts first.
    """
    stacked = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("metric"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)
    ])).alias("x")).select(key, "x.metric", "x.value")
    found = prefix_by_value(stacked, "value", {"c": F.count(F.lit(1))}, by="metric")
    rank = F.when(F.col("c_total") > 1, F.col("c_before") / (F.col("c_total") - 1)).otherwise(F.lit(0.0))
    found = found.select(F.col("metric").alias("_m"), "_v", rank.alias("_rank"))
    joined = stacked.join(found, (F.col("metric") == F.col("_m")) & F.col("value").eqNullSafe(F.col("_v")))
    return joined.groupBy(key).agg(*[
        F.max(F.when(F.col("metric") == i, F.col("_rank"))).alias(f"rank_{i}") for i in range(len(columns))])


def global_percent_rank(df: DataFrame, column: str, out: str, descending: bool = False,
                        buckets: int = BUCKETS, base: DataFrame | None = None) -> DataFrame:
    """Add percent_rank() OVER (ORDER BY column [DESC]).

    NULL sorts first ascending and last descending, as in Spark's window. The rank is
    joined back on the value, where a very common value is split as a skewed key.
    ``base`` gives the ranked values when ``df`` already carries other ranks.
    """
    ranked = prefix_by_value(base if base is not None else df, column, {"c": F.count(F.lit(1))}, buckets)
    smaller = F.col("c_total") - F.col("c_before") - F.col("c") if descending else F.col("c_before")
    rank = F.when(F.col("c_total") > 1, smaller / (F.col("c_total") - 1)).otherwise(F.lit(0.0))
    ranked = ranked.select("_v", rank.alias(out))
    return df.join(ranked, df[column].eqNullSafe(ranked["_v"])).drop("_v")


def average_precision(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision as a one-row table: precision at each threshold, weighted by gained recall."""
    positive = F.sum(F.col(label).cast("double"))
    steps = prefix_by_value(scored, score, {"n": F.count(F.lit(1)), "p": positive})
    hits = F.col("p_total") - F.col("p_before")
    taken = F.col("n_total") - F.col("n_before")
    return steps.agg(F.sum(F.try_divide(F.col("p"), F.col("p_total")) * hits / taken).alias("average_precision"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve as a one-row table, by rank sums: equal scores count half. NULL with one class only."""
    positive = F.sum(F.col(label).cast("double"))
    steps = prefix_by_value(scored, score, {"n": F.count(F.lit(1)), "p": positive})
    lost, below = F.col("n") - F.col("p"), F.col("n_before") - F.col("p_before")
    pairs = F.max(F.col("p_total") * (F.col("n_total") - F.col("p_total")))
    return steps.agg(F.try_divide(F.sum(F.col("p") * (below + lost / 2)), pairs).alias("roc_auc"))
