"""Ingestion of transaction tables: casts, identity join, entity key, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.functions.expressions import entity_key
from tallyguard.operators.ordering import key_ranges
from tallyguard.operators.skew import skewed_left_join
from tallyguard.sources.files import file_order_id, read_csv, write_parquet
from tallyguard.sources.synthetic import synthetic_tables
from tallyguard.sources.versions import exists

# Name parts that mark a non-negative 32-bit column, the entity key parts, and the
# entity of a table without any key part.
UNSIGNED_TERMS = ("id", "dt", "count", "card", "addr")
ENTITY_PARTS = ("card1", "card2", "card3", "card4", "addr1", "D1")
MAX_UNSIGNED = 2**32 - 1
ONLY_ENTITY = "entity_0"


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to float; longs to int, or to a checked non-negative long when the name says so.

    Spark has no unsigned type, so such a column stays long and a value outside 0..2^32-1 is an
    error, as is a value that does not fit an int.
    """
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = c.cast("float")
        elif isinstance(f.dataType, T.LongType):
            if any(term in f.name.lower() for term in UNSIGNED_TERMS):
                complaint = F.concat(F.lit(f"{f.name} outside 0..{MAX_UNSIGNED}: "), c.cast("string"))
                fits = c.isNull() | c.between(0, MAX_UNSIGNED)
                c = F.when(fits, c).otherwise(F.raise_error(complaint).cast("long"))
            else:
                c = c.cast("int")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def join_identity(
    transactions: DataFrame, identity: DataFrame, key: str = "TransactionID", hot_rows: int | None = None
) -> DataFrame:
    """Left join that keeps every transaction; clashing identity columns get ``_right``.

    The key is near unique, so by default nothing is counted and adaptive execution splits a
    crowded partition. With ``hot_rows`` keys above that many rows on either side are counted
    and cut beforehand.
    """
    clashes = {c: f"{c}_right" for c in identity.columns if c != key and c in transactions.columns}
    spread = [c for c in transactions.columns if c != key] or [key]
    right = identity.withColumnsRenamed(clashes)
    right_spread = [c for c in right.columns if c != key] or [key]
    if hot_rows is None:
        joined = transactions.join(right, key, "left")
    else:
        joined = skewed_left_join(transactions, right, key, spread, right_spread, hot_rows)
    added = [clashes.get(c, c) for c in identity.columns if c != key]
    return joined.select(*transactions.columns, *added)


def with_entity(df: DataFrame, name: str = "card_id", parts: Sequence[str] = ENTITY_PARTS) -> DataFrame:
    """Composite entity key; without the parts the first card column, else one constant."""
    first, last = parts[0], parts[-1]
    if first in df.columns and last in df.columns:
        return df.withColumn(name, entity_key(df, list(parts)))
    if first in df.columns:
        return df.withColumn(name, F.col(first).cast("string"))
    return df.withColumn(name, F.lit(ONLY_ENTITY))


def chronological(df: DataFrame, time: str, tie: str, measured: DataFrame | None = None) -> DataFrame:
    """Range-partitioned by time and sorted inside, so files written in order are sorted.

    The range edges are measured beforehand on ``measured``, which has the same keys as ``df``
    and may be a plain scan; by default on ``df`` itself. A row's partition is the number of its
    range, so that Spark does not run the plan behind ``df`` a second time to sample it.
    """
    if time not in df.columns:
        return df
    numeric = all(c in df.columns and isinstance(df.schema[c].dataType, T.NumericType) for c in (time, tie))
    if not numeric:
        keys = [time, tie] if tie in df.columns else [time]
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = key_ranges(df if measured is None else measured, time, tie)
    placed = ranges.numbered(df, "_part").repartitionById(ranges.count, "_part")
    return placed.sortWithinPartitions(F.col(time).asc_nulls_last(), tie).drop("_part")


def ingest_transactions(
    transactions: DataFrame, identity: DataFrame | None = None, out: str | None = None
) -> DataFrame:
    """Cast, join identity when given, add the entity key, and write in time order."""
    merged = downcast(transactions)
    if identity is not None:
        merged = join_identity(merged, downcast(identity))
    merged = with_entity(merged)
    if out is None:
        return merged
    # The join keeps every transaction, so the plain table has all keys to measure.
    keys = [c for c in ("TransactionDT", "TransactionID") if c in transactions.columns]
    measured = downcast(transactions.select(*keys)) if len(keys) == 2 else None
    write_parquet(chronological(merged, "TransactionDT", "TransactionID", measured), out)
    return merged.sparkSession.read.parquet(out)


def ingest_ledger(
    ledger: DataFrame, out: str | None = None, seconds_per_step: int = 1
) -> DataFrame:
    """Step-based ledger (``step``, ``nameOrig``, ``isFraud``, ...) read from files.

    The row id is dense in file order, taken before any sort. The step becomes the time.
    """
    if "isFraud" not in ledger.columns:
        raise ValueError("the ledger has no isFraud column")
    rows = downcast(file_order_id(ledger, "TransactionID")).withColumns(
        {
            "TransactionDT": F.col("step").cast("long") * F.lit(seconds_per_step),
            "card_id": F.col("nameOrig").cast("string"),
        }
    )
    if out is None:
        return rows
    write_parquet(chronological(rows, "TransactionDT", "TransactionID"), out)
    return ledger.sparkSession.read.parquet(out)


def run_ingestion(
    spark: SparkSession,
    out: str,
    transaction_csv: tuple[str, T.StructType | str] | None = None,
    identity_csv: tuple[str, T.StructType | str] | None = None,
    ledger_csv: tuple[str, T.StructType | str] | None = None,
    synthetic_rows: int = 60_000,
    seconds_per_step: int = 1,
) -> DataFrame:
    """The first source that exists wins: transactions, then ledger, else generated rows."""
    if transaction_csv and exists(spark, transaction_csv[0]):
        identity = None
        if identity_csv and exists(spark, identity_csv[0]):
            identity = read_csv(spark, *identity_csv)
        return ingest_transactions(read_csv(spark, *transaction_csv), identity, out)
    if ledger_csv and exists(spark, ledger_csv[0]):
        return ingest_ledger(read_csv(spark, *ledger_csv), out, seconds_per_step)
    entities = max(500, synthetic_rows // 20)
    transactions, identity = synthetic_tables(spark, synthetic_rows, entities)
    return ingest_transactions(transactions, identity, out)
