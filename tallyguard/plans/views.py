"""The transaction views that the queries read, over the shared test tables."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions.expressions import epoch_seconds
from tallyguard.operators.split import temporal_split
from tallyguard.session import shared_folder

CATALOG: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # The tables hold timestamps without a zone; seconds since 1970 are read as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, folder)

        CATALOG[function.__name__] = (run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder for a table that is written and read back."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def r6(value: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero removed."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c, digits) + F.lit(0.0)


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as card transactions; the label and the score are functions of the event."""
    amount = F.col("value")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("TransactionID"),
        epoch_seconds("ts").alias("TransactionDT"),
        F.col("user_id").alias("card1"),
        amount.alias("TransactionAmt"),
        F.col("event_type").alias("ProductCD"),
        F.expr("cast(nullif(cast(get_json_object(props, '$.k') as int) div 10, 0) as int)").alias("C1"),
        F.when((F.col("event_type") == "error") & (amount >= 90), 1).otherwise(0).alias("isFraud"),
        F.round(1 / (1 + F.exp(-(amount - 90) / 30)), 3).alias("score"),
    )


def split_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return temporal_split(transactions(spark, folder))


def three_models(rows: DataFrame) -> DataFrame:
    """The rows once per model, with that model's score as ``p``."""
    s = F.col("score")
    scores = F.array(
        F.struct(F.lit("XGBoost").alias("model"), s.alias("p")),
        F.struct(F.lit("RandomForest").alias("model"), (s * s).alias("p")),
        F.struct(F.lit("Mirror").alias("model"), (1 - s).alias("p")),
    )
    return rows.select("*", F.inline(scores))


def order_times(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("t", epoch_seconds("o_orderdate"))


# The same views in SQL, as common table expressions.
TXN = """
txn AS (
  SELECT event_id AS TransactionID, floor(epoch_us(ts) / 1000000)::BIGINT AS TransactionDT,
         user_id AS card1, value AS TransactionAmt, event_type AS ProductCD,
         nullif(json_extract_string(props, '$.k')::INT // 10, 0)::INT AS C1,
         CASE WHEN event_type = 'error' AND value >= 90 THEN 1 ELSE 0 END AS isFraud,
         round(1 / (1 + exp(-(value - 90) / 30)), 3) AS score
  FROM events)"""

SPLIT = (
    TXN
    + """,
ranked AS (
  SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) AS rn, count(*) OVER () AS n
  FROM txn),
parts AS (
  SELECT * EXCLUDE (rn, n),
         CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
              WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev'
              ELSE 'test' END AS split
  FROM ranked)"""
)

LONG = (
    SPLIT
    + """,
scored AS (
  SELECT *, 'XGBoost' AS model, score AS p FROM parts
  UNION ALL SELECT *, 'RandomForest', score * score FROM parts
  UNION ALL SELECT *, 'Mirror', 1 - score FROM parts)"""
)


def ranking_ctes(source: str, by: str) -> str:
    """Distinct scores of ``source`` with running counts, one row per (by, score)."""
    return f"""
pts AS (SELECT {by}, p, sum(isFraud)::DOUBLE AS pos, count(*)::DOUBLE AS n
        FROM {source} GROUP BY {by}, p),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cn,
               sum(pos) OVER (PARTITION BY {by}) AS pa, sum(n) OVER (PARTITION BY {by}) AS na
        FROM pts
        WINDOW w AS (PARTITION BY {by} ORDER BY p DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
areas AS (SELECT {by},
  CASE WHEN min(pa) = 0 OR min(pa) = min(na) THEN 0 ELSE sum(pos / nullif(pa, 0) * tp / cn) END AS pr_auc,
  CASE WHEN min(pa) = 0 OR min(pa) = min(na) THEN 0.5
       ELSE sum((n - pos) * (tp - pos / 2) / nullif(pa * (na - pa), 0)) END AS roc_auc,
  CASE WHEN min(pa) = 0 OR min(pa) = min(na) THEN 0
       ELSE max(CASE WHEN tp / cn >= 0.95 THEN tp / nullif(pa, 0) ELSE 0 END) END AS recall_at_95_precision
  FROM cum GROUP BY {by})"""


def sweep_ctes(source: str, by: str, low: int = 1, high: int = 99) -> str:
    """Confusion counts of ``source`` at each threshold of the grid."""
    return f"""
sweep AS (SELECT {by}, i::DOUBLE / 100 AS threshold,
  sum(CASE WHEN p >= i::DOUBLE / 100 AND isFraud = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
  sum(CASE WHEN p >= i::DOUBLE / 100 AND isFraud = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN p < i::DOUBLE / 100 AND isFraud = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn,
  sum(CASE WHEN p < i::DOUBLE / 100 AND isFraud = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn
  FROM {source}, range({low}, {high + 1}) g(i) GROUP BY {by}, i)"""
