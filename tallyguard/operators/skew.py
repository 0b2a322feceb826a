"""Joins that stay balanced when keys hold a large share of the rows, on either side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.session import durable

#: Rows of one key that a task takes; a key with more is cut into as many parts as it needs.
HOT_ROWS = 2_000_000
#: Hot keys that may be sent to every worker; beyond that they are joined by key.
SENT_KEYS = 100_000


def hot_counts(df: DataFrame, key: str, limit: int = HOT_ROWS) -> DataFrame:
    """(key, n) of every value of ``key`` with more than ``limit`` rows, as a durable table."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return durable(counted.where(F.col("n") > limit))


def attached(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``keys``, which has one row for some values of ``key``."""
    few = keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left")


def with_hot_flag(df: DataFrame, key: str, limit: int, name: str) -> tuple[DataFrame, bool]:
    """``df`` with a flag for rows of hot keys, and whether there are any."""
    hot = hot_counts(df, key, limit).select(key, F.lit(True).alias(name))
    if not hot.limit(1).count():
        return df.withColumn(name, F.lit(False)), False
    return attached(df, hot, key).withColumn(name, F.coalesce(name, F.lit(False))), True


def _parts(limit: int) -> Column:
    return F.ceil(F.col("n") / max(limit, 1)).cast("int")


def _salt(spread: Sequence[str], parts: str) -> Column:
    return F.pmod(F.xxhash64(*spread), F.col(parts)).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    hot: DataFrame | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` with hot and null keys spread over many tasks.

    A key with n rows on the left, as counted there or given by ``hot`` (key, n), is cut into
    n / limit parts by the ``spread`` columns, and the matching right rows are repeated once per
    part. Null keys match nothing, so they are spread without repeating anything.
    """
    hot = hot_counts(left, key, limit) if hot is None else hot
    return _joined(left, right, key, spread, hot.select(key, _parts(limit).alias("_left_parts")))


def _joined(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], parts: DataFrame) -> DataFrame:
    one = F.coalesce("_left_parts", F.lit(1))
    salted_left = attached(left, parts, key).withColumn("_left_parts", one)
    salted_left = salted_left.withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.hash(*spread)).otherwise(_salt(spread, "_left_parts")),
    )
    salted_right = attached(right.where(F.col(key).isNotNull()), parts, key).withColumn("_left_parts", one)
    salted_right = salted_right.withColumn("_salt", _every("_left_parts")).drop("_left_parts")
    return salted_left.drop("_left_parts").join(salted_right, [key, "_salt"], "left").drop("_salt")


def skewed_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_spread: Sequence[str],
    right_spread: Sequence[str],
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Left join for tables where either side, or both, may repeat one key very often.

    Keys that are hot on the right surely match, so they join as an inner join over a grid: the
    left rows of a key are cut into parts and repeated for every part of the right rows, and the
    other way round. The other keys join as a left join.
    """
    left_parts = hot_counts(left, key, limit).select(key, _parts(limit).alias("_left_parts"))
    right_parts = hot_counts(right, key, limit).select(key, _parts(limit).alias("_right_parts"))
    if not right_parts.limit(1).count():
        return _joined(left, right, key, left_spread, left_parts)
    one = {c: F.coalesce(c, F.lit(1)) for c in ("_left_parts", "_right_parts")}
    crowded = F.col("_right_parts").isNotNull()
    near = attached(left, right_parts, key)
    far = attached(right, right_parts, key)
    usual = _joined(
        near.where(~crowded).drop("_right_parts"), far.where(~crowded).drop("_right_parts"), key, left_spread, left_parts
    )
    grid_left = attached(near.where(crowded), left_parts, key).withColumns(one)
    grid_left = grid_left.withColumn("_a", _salt(left_spread, "_left_parts")).withColumn("_b", _every("_right_parts"))
    grid_right = attached(far.where(crowded), left_parts, key).withColumns(one)
    grid_right = grid_right.withColumn("_b", _salt(right_spread, "_right_parts")).withColumn("_a", _every("_left_parts"))
    parts = ["_left_parts", "_right_parts"]
    grid = grid_left.drop(*parts).join(grid_right.drop(*parts), [key, "_a", "_b"]).drop("_a", "_b")
    return usual.unionByName(grid)
