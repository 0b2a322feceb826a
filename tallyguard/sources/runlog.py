"""Run log: one row per model run with its full parameters and metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, model string, params map<string,string>, metrics map<string,double>"
)


def run_rows(
    metrics: DataFrame, model: str = "model", params: Mapping[str, Mapping] | None = None, run_id: str | None = None
) -> DataFrame:
    """Run records from a metrics table with one row per model.

    Every metric column goes into a map. Parameters are kept whole, nested values as JSON text.
    A run's id is the model with ``run_id``, by default a fresh one.
    """
    names = [c for c in metrics.columns if c != model]
    pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("double"))]
    given = F.lit(None).cast("map<string,string>")
    for name, values in (params or {}).items():
        texts = [
            F.lit(x)
            for key, value in values.items()
            for x in (str(key), value if isinstance(value, str) else json.dumps(value))
        ]
        as_map = F.create_map(*texts).cast("map<string,string>")
        given = F.when(F.col(model) == name, as_map).otherwise(given)
    return metrics.select(
        F.concat_ws("-", F.col(model), F.lit(run_id or uuid.uuid4().hex)).alias("run_id"),
        F.col(model).alias("model"),
        given.alias("params"),
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metrics"),
    )


def append_runs(runs: DataFrame, path: str, batch: str | None = None) -> None:
    """Add runs to the log. Runs of a named ``batch`` replace those of the same batch, so that a
    job that is started again does not log twice; without a name they are always added."""
    rows = runs.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RUN_SCHEMA}, batch string").parquet(path).drop("batch")
