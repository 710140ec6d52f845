"""Token counts by source, language and tokenizer version, kept up to date by signed changes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
#: One change: `change_id` is unique within its batch; `op` is insert, delete or revise; the old columns hold what was
#: counted before (NULL for an insert), the others what counts now (NULL for a delete).
CHANGES = ("change_id string, op string, tokenizer string, source string, lang string, n_tokens long, "
           "old_source string, old_lang string, old_tokens long")


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows (source, lang, tokenizer, n_docs, n_tokens): an insert adds, a delete takes away, a revision does both.

    A change that stands twice in the batch counts once. NULL groups are groups of their own, a NULL count is 0, and an
    unknown `op` is an error when the rows are read.
    """
    once = changes.dropDuplicates(["change_id"])
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("NULL")))))
    plus = F.struct(F.col("source").alias("source"), F.col("lang").alias("lang"), F.lit(1).alias("n_docs"),
                    F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    minus = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).alias("n_docs"),
                     (-F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    parts = F.when(known == "insert", F.array(plus)).when(known == "delete", F.array(minus)).otherwise(
        F.array(minus, plus))
    return once.select("tokenizer", F.explode(parts).alias("part")).select(
        "part.source", "part.lang", "tokenizer", F.col("part.n_docs").cast("long").alias("n_docs"), "part.n_tokens")


def summed(rows: DataFrame) -> DataFrame:
    """One row per group. Sums are combined before they are shuffled, so a hot source costs a row per task."""
    return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@dataclass(frozen=True)
class Rollup:
    """Totals below a folder that all executors reach.

    Every attempt to commit a batch writes its sums to a folder of its own, and then publishes it with one small row. Only
    the attempt that was published last counts for a batch, so a commit that is repeated, after a failure or by mistake,
    changes nothing, one that dies is not seen, and what was committed before stays readable all the time. Two commits of
    one batch at the same time are not foreseen.
    """

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing was committed yet

    def published(self) -> DataFrame:
        """(batch_id, attempt) of the attempts that count."""
        rows = self._read("published", "batch_id long, turn long, attempt string")
        return rows.groupBy("batch_id").agg(F.max(F.struct("turn", "attempt")).alias("last")).select("batch_id", "last.attempt")

    def write_attempt(self, batch_id: int, changes: DataFrame) -> str:
        """Write the sums of a batch where nobody reads them yet."""
        attempt = uuid.uuid4().hex
        summed(signed(changes)).write.parquet(f"{self.path}/sums/batch_id={int(batch_id)}/attempt={attempt}")
        return attempt

    def publish(self, batch_id: int, attempt: str) -> None:
        """Let an attempt count from now on, in place of earlier ones of its batch."""
        before = self._read("published", "batch_id long, turn long, attempt string").where(F.col("batch_id") == int(batch_id)).count()
        row = self.spark.createDataFrame([(int(batch_id), before, attempt)], "batch_id long, turn long, attempt string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/published")

    def commit(self, batch_id: int, changes: DataFrame) -> None:
        self.publish(batch_id, self.write_attempt(batch_id, changes))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the groups that have documents or tokens left."""
        sums = self._read("sums", f"{SUMS}, batch_id long, attempt string")
        return summed(sums.join(self.published(), ["batch_id", "attempt"])).where("n_docs <> 0 OR n_tokens <> 0")
