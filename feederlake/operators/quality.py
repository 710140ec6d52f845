"""Data-quality rules: fail, drop or warn, counted in the same pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

FAIL, DROP, WARN = "fail", "drop", "warn"


@dataclass(frozen=True)
class Rule:
    """A named SQL predicate; NULL counts as a violation, as in a filter."""

    name: str
    predicate: str
    action: str

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.predicate).cast("boolean"), F.lit(False))


def _violations(rules: Sequence[Rule]) -> list[Column]:
    return [F.count_if(~r.holds()).alias(r.name) for r in rules]


def enforce(df: DataFrame, rules: Sequence[Rule], observation: Observation | None = None) -> DataFrame:
    """Apply the rules. Counters, when asked for, are collected while the rows flow."""
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"), *_violations(rules))
    for rule in rules:
        if rule.action == FAIL:
            abort = F.raise_error(F.lit(f"data-quality rule {rule.name} failed")).cast("boolean")
            df = df.filter(F.when(rule.holds(), F.lit(True)).otherwise(abort))
        elif rule.action == DROP:
            df = df.filter(rule.holds())
    return df


def count_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: how many of the incoming rows violate it."""
    totals = df.agg(*_violations(rules))
    pairs = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"),
                      F.col(r.name).alias("violations")) for r in rules]
    return totals.select(F.explode(F.array(*pairs)).alias("v")).select("v.*")
