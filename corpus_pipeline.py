"""From raw documents to packed training sequences: the stages in order, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederlake.llm import crf, gam, packing, repeats, simhash
from feederlake.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, learnt from the labelled ones, scores at 0.3 or more."""
    return gam.score(docs, gam.fit(docs, _labels(spark, sf_dir))).where("predicted = 1").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have half of their words or more in content lines.

    The lines are learnt from the labelled documents of the whole table: hardly any boilerplate reaches this stage.
    """
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return crf.judged(docs, crf.fit(table, _labels(spark, sf_dir))).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.without_near_copies(docs, width=5, similarity=0.8)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes covered by strings of 200 bytes that occur more than once.

    Where a cut falls inside a character, what is left of it goes too.
    """
    left = repeats.without_repeats(docs, length=200, as_text=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return left.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The learnt and hashed stages are beyond SQL; the tests compare them with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
