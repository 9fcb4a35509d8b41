"""Documents to tokens: language, quality, near duplicates, benchmark passages, byte-pair ids.

All stages but the last return whole rows with the columns of `documents`, whatever their names. An empty table gives an empty one in
every stage; empty `labels` or an empty `benchmark` reject nothing of their own. Null ids are ids like any other until one
document of a class is chosen, where they come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import bpe, decontaminate, langid, near, quality
from chatloom.llm.common import small_batches, table
from chatloom.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without a letter go. Equal texts, repeated rows too, get one answer."""
    small_batches(spark)
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest, calibrated on the labelled ones among them. Equal texts get one answer.

    Labels of ids that aren't there and null labels don't count.
    """
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id, of equal ids the least text key.

    Rows that agree in id and text are one document; wordless texts are no duplicates and stay.
    """
    small_batches(spark)
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages; wordless texts and items match nothing."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts as digests, a row for each document; null and empty texts have no ids."""
    small_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_pairs", byte_pairs),
]

# Models and chosen paths have no SQL: each stage is tested against a plain version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
