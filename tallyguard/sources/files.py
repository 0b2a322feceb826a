"""CSV and Parquet tables. Schemas are given, never inferred by reading the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.session import durable


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row, read against an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Zstandard Parquet, optionally one folder per value of the partition columns."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_predictions(df: DataFrame, path: str, model: str = "model") -> None:
    """Scores of one or more models, one folder per model so that readers prune.

    Only the folders of the models in ``df`` are replaced; other models' predictions stay.
    """
    writer = df.write.mode("overwrite").option("compression", "zstd")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(model).parquet(path)


# Suffixes under which a model's predictions may have been stored.
MODEL_SUFFIXES = ("", "_Baseline", "_Sequence")


def read_predictions(spark: SparkSession, path: str, model: str, column: str = "model") -> DataFrame:
    """Predictions of one model; the plain name wins over its suffixed forms.

    Only the model folders are listed to choose the name, the rows are pruned by partition.
    """
    base = model
    for suffix in MODEL_SUFFIXES[1:]:
        base = base.removesuffix(suffix)
    wanted = list(dict.fromkeys([model, base, *[base + s for s in MODEL_SUFFIXES[1:]]]))
    stored = spark.read.parquet(path)
    present = {
        r[0] for r in stored.where(F.col(column).isin(wanted)).select(column).distinct().collect()
    }
    for name in wanted:
        if name in present:
            return stored.where(F.col(column) == name)
    raise FileNotFoundError(f"no predictions of {model} under {path}")


def file_order_id(df: DataFrame, name: str) -> DataFrame:
    """Dense zero-based id in file order for a frame read straight from files.

    A row is placed by its file, its block and its place inside the block. The placed rows are
    made durable before blocks are counted, so that ids do not depend on a second scan being cut
    like the first. Only one row per block is aggregated, so the data is not shuffled.
    """
    block = ["_path", "_start"]
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    placed = durable(placed)
    blocks = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"), F.min("_seen").alias("_first"))
    # One row per input block: an unpartitioned window over the block list is small.
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(
        blocks.select(*block, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    )
    # Adaptive execution sends the block list to all workers where its measured size allows.
    return (
        placed.join(offsets, block, "left")
        .withColumn(name, (F.col("_off") + F.col("_seen") - F.col("_first")).cast("long"))
        .drop(*block, "_seen", "_first", "_off")
    )
