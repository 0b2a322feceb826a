"""Query registration, durable intermediate tables and batch helpers of this folder."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.session import shared_folder

CATALOG: dict[str, tuple] = {}

#: Rows and bytes handed to a Python worker at once; texts may be long, so few.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches small, so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its name, with the SQL that must give the same rows."""

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            bounded_batches(spark)
            return function(spark, folder)

        CATALOG[name or function.__name__] = (run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, *partition: str, **options: str) -> DataFrame:
    """The rows as a table in the folder that all executors share; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}"
    write = df.write.options(**options)
    write.parquet(path) if not partition else write.partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that may be sent to every worker to pick rows by.
SENT_KEYS = 1_000_000


def sent_if_few(keys: DataFrame, most: int = SENT_KEYS) -> DataFrame:
    """``keys`` as a written table, marked to be sent to all workers if it has few rows."""
    keys = written(keys)
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem
