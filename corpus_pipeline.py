"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Documents without text pass every filter and are packed as their end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import bounded_batches, table, written
from tallyguard.llm.decontaminate import decontaminate
from tallyguard.llm.jaccard import keep_first_of_groups
from tallyguard.llm.packing import pack_documents
from tallyguard.llm.pii import replace_entities
from tallyguard.llm.quality import keep_quality
from tallyguard.llm.queries import SURROGATE_KEY

#: The stages hold iterative work and byte-exact tokenizers, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier rejects or finds toxic go."""
    bounded_batches(spark)
    return keep_quality(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, the one with the smallest id stays."""
    bounded_batches(spark)
    return keep_first_of_groups(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    bounded_batches(spark)
    return decontaminate(docs, table(spark, folder, "benchmark"), remove="documents")


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data and secrets get surrogates; the character count follows the new text."""
    bounded_batches(spark)
    clean = replace_entities(docs, SURROGATE_KEY)
    if "n_chars" not in clean.columns:
        return clean
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(count, F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces in sequences of 2,048."""
    bounded_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(docs, path, end_id=1, capacity=2048)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
