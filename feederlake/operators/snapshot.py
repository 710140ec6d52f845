"""Snapshot merge: a keyed table brought in line with a new full result.

The comparison yields inserts, updates and deletes. They are kept as a change feed
next to the snapshot, which other stores follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.session import settle
from feederlake.sources.tables import TableStore

INSERT, UPDATE, DELETE, SAME = "I", "U", "D", "S"


def classify(old: DataFrame, new: DataFrame, key: str, volatile: Sequence[str] = ()) -> DataFrame:
    """Every key of either side with its operation and the values after it.

    Columns only the new side has are added; columns only the old side has keep their
    value. Volatile columns (time stamps) alone do not make an update. A deleted key
    shows its last values.
    """
    old_only = [c for c in old.columns if c not in new.columns]
    compared = [c for c in new.columns if c != key and c not in volatile]
    left, right = old.alias("o"), new.alias("n")
    joined = left.join(right, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    differs = [
        ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) if c in old.columns else F.col(f"n.{c}").isNotNull()
        for c in compared]
    changed = reduce(lambda a, b: a | b, differs, F.lit(False))
    op = (F.when(F.col(f"o.{key}").isNull(), INSERT).when(F.col(f"n.{key}").isNull(), DELETE)
          .when(changed, UPDATE).otherwise(SAME))

    def value(c: str):
        if c not in old.columns:
            return F.col(f"n.{c}").alias(c)
        if c in volatile:
            return F.when(op.isin(INSERT, UPDATE), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return F.when(op == DELETE, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return joined.select(op.alias("_op"), *[value(c) for c in new.columns],
                         *[F.col(f"o.{c}").alias(c) for c in old_only])


def check_keys(df: DataFrame, key: str, side: str) -> None:
    """Raise if a key is NULL or stands on several rows: a full outer join would multiply them on every merge."""
    wrong = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).take(1)
    if wrong:
        raise ValueError(f"{side}: key {key} = {wrong[0][0]!r} stands on {wrong[0]['count']} rows")


def changes(old: DataFrame, new: DataFrame, key: str, volatile: Sequence[str] = ()) -> DataFrame:
    return classify(old, new, key, volatile).filter(F.col("_op") != SAME)


class KeyedTable:
    """A stored snapshot with a change feed, one folder per version."""

    def __init__(self, store: TableStore, name: str, key: str, volatile: Sequence[str] = ()):
        self.store, self.name, self.key, self.volatile = store, name, key, tuple(volatile)

    @property
    def feed_path(self) -> str:
        return f"{self.store.root}/{self.name}__changes"

    def snapshot(self) -> DataFrame:
        return self.store.read(self.name)

    def merge(self, new: DataFrame) -> dict[str, int]:
        """Bring the snapshot in line; returns the number of rows per operation.

        The feed is written before the snapshot is committed; a repeat after a crash
        writes the same version again. Without a change nothing is written.
        """
        version = self.store.version(self.name)
        new = settle(new, "incoming")
        check_keys(new, self.key, "new rows")
        if version:
            check_keys(self.snapshot(), self.key, f"{self.name} as stored")
            compared = classify(self.snapshot(), new, self.key, self.volatile)
        else:
            compared = new.select(F.lit(INSERT).alias("_op"), "*")
        compared = settle(compared, "merge")
        counts = {op: n for op, n in compared.groupBy("_op").count().collect()}  # at most four rows
        if version and not any(counts.get(op) for op in (INSERT, UPDATE, DELETE)):
            return counts
        (compared.filter(F.col("_op") != SAME)
         .write.mode("overwrite").parquet(f"{self.feed_path}/change_version={version + 1}"))
        self.store.replace(self.name, compared.filter(F.col("_op") != DELETE).drop("_op"), version=version + 1)
        return counts
