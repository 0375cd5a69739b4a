"""The corpus pipeline: quality, toxicity, exact and near copies, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again for the next one. The first four return rows of docs with all their columns. Null texts
count as empty, and empty ones as sound and civil; rows are judged one by one, so ids may be null or repeated; no documents
give no rows. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telluric.llm.exact_dedup import without_copies
from telluric.llm.quality import sound
from telluric.llm.queries import packed, prepare, table
from telluric.llm.shared import folder, remove, saved, temporary
from telluric.llm.simhash_dedup import one_of_each
from telluric.llm.toxicity import civil, training_rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject; repeated rows have the same verdict."""
    prepare(spark)
    return sound(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic, by what their labelled ones teach; without labels of both kinds all of them or none."""
    return civil(docs, training_rows(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; of rows that repeat an id and a text one stays."""
    prepare(spark)
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, with the smallest id."""
    prepare(spark)
    return one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    prepare(spark)
    return packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("packing", packing_stage),
]

#: The classifiers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves in the shared folder is deleted once the next one has read it."""
    path, docs, before = folder(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark):
            docs = saved(stage(spark, docs, sf_dir), f"{path}/{name}")
        if before:
            remove(spark, f"{path}/{before}")
        before = name
    return docs
