"""From raw documents to packed token sequences, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of ``documents``, whatever others the
table has beside them.

Null, empty and blank texts fail the first stage's base rules and go. Rows that
repeat id and text are copies of which the second stage leaves one. Rows that
share an id but not their text are documents of their own in every stage. A tie
is decided by the smallest id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hunkflow.llm import exact_dedup, mixing, near_join, packing, quality_rules
from hunkflow.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.public_tokenizer())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]

#: Tokenising is beyond SQL; tests hold the rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. The tables between the
    stages are deleted when the application ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
