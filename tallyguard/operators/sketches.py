"""Mergeable quantile sketches that are merged in two levels.

A plain aggregate without keys sends one sketch of every input task to a single task. Here the
tasks are dealt into groups first; each group's sketches are merged in parallel and only one
sketch per group reaches the last task, however many tasks read the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of tasks whose sketches are merged on their own; near the root of a large task count.
MOST_GROUPS = 1024
#: Size parameter of a sketch. The largest one ranks a value with an error near 1 in 10,000.
SMALLEST, LARGEST = 200, 65_535
GROUP = "_task_group"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def task_group_count(spark: SparkSession) -> int:
    """Into how many groups tasks are dealt: the shuffle width, within bounds."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, min(MOST_GROUPS, width))


def task_groups(df: DataFrame) -> Column:
    """The number of the group that a row's task belongs to."""
    return F.pmod(F.spark_partition_id(), F.lit(task_group_count(df.sparkSession)))


def size_for(pieces: int) -> int:
    """Sketch size whose rank error is well below one of ``pieces`` shares."""
    return max(SMALLEST, min(LARGEST, 40 * pieces))


def _typed(df: DataFrame, value: Column) -> tuple[Column, str]:
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, _WHOLE):
        return value.cast("long"), "bigint"
    return value.cast("double"), "double"


def grouped(
    df: DataFrame, sums: Mapping[str, Column], sketches: Mapping[str, Column], k: int
) -> tuple[DataFrame, dict[str, str]]:
    """One row per task group: the plain aggregates ``sums`` and a sketch of each value."""
    kinds, built = {}, []
    for name, value in sketches.items():
        typed, kinds[name] = _typed(df, value)
        if kinds[name] == "double":
            typed = F.when(~F.isnan(typed), typed)
        built.append(getattr(F, f"kll_sketch_agg_{kinds[name]}")(typed, F.lit(k)).alias(name))
    plain = [c.alias(name) for name, c in sums.items()]
    return df.groupBy(task_groups(df).alias(GROUP)).agg(*plain, *built), kinds


def _points(sketch: Column, kind: str, shares: Sequence[float]) -> Column:
    return getattr(F, f"kll_sketch_get_quantile_{kind}")(sketch, F.array(*[F.lit(float(x)) for x in shares]))


@dataclass
class Sketches:
    """Merged sketches and exact totals of one pass; quantiles are read without a new pass."""

    spark: SparkSession
    totals: dict[str, int]
    merged: dict[str, bytearray | None]
    kinds: dict[str, str]

    def at(self, shares: Mapping[str, Sequence[float]]) -> dict[str, list]:
        """Values near the given shares per name; an empty list for a column without values."""
        asked = [n for n in shares if len(shares[n]) and self.merged[n] is not None]
        found: dict[str, list] = {n: [] for n in shares}
        if not asked:
            return found
        # The sketches are literals, so that this is no job over data.
        row = self.spark.range(1).select(
            *[
                _points(F.lit(bytes(self.merged[n])), self.kinds[n], shares[n]).alias(f"q{i}")
                for i, n in enumerate(asked)
            ]
        ).first()
        return found | {n: list(row[i]) for i, n in enumerate(asked)}


def _merged(
    df: DataFrame, values: Mapping[str, Column], totals: Mapping[str, Column], k: int
) -> tuple[DataFrame, dict[str, str]]:
    parts, kinds = grouped(df, totals, values, k)
    return parts.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in totals],
        *[getattr(F, f"kll_merge_agg_{kinds[name]}")(F.col(name)).alias(name) for name in values],
    ), kinds


def sketched(
    df: DataFrame, values: Mapping[str, Column], totals: Mapping[str, Column] | None = None, k: int = LARGEST
) -> Sketches:
    """One pass: a sketch of each value, nulls and NaN left out, and totals that add up.

    Whole numbers are kept whole, all other values become double. What reaches the driver is
    one sketch per value and one number per total.
    """
    totals = dict(totals or {})
    merged, kinds = _merged(df, values, totals, k)
    row = merged.select(
        *totals,
        *[F.when(getattr(F, f"kll_sketch_get_n_{kinds[n]}")(F.col(n)) > 0, F.col(n)).alias(n) for n in values],
    ).first()
    return Sketches(df.sparkSession, {n: row[n] for n in totals}, {n: row[n] for n in values}, kinds)


def quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    shares: Mapping[str, Sequence[float]],
    totals: Mapping[str, Column] | None = None,
    k: int = LARGEST,
) -> tuple[dict[str, list], dict[str, int]]:
    """Values near the given shares of each column, and exact totals, from one job."""
    totals = dict(totals or {})
    merged, kinds = _merged(df, values, totals, k)
    asked = [n for n in values if len(shares[n])]
    row = merged.select(
        *totals,
        *[
            F.when(getattr(F, f"kll_sketch_get_n_{kinds[n]}")(F.col(n)) > 0, _points(F.col(n), kinds[n], shares[n])).alias(n)
            for n in asked
        ],
    ).first()
    return {n: list(row[n] or []) if n in asked else [] for n in values}, {n: row[n] for n in totals}


def rank_error(k: int) -> float:
    """Share by which a sketch of size ``k`` may miss a rank, at the 99 % level."""
    return 2.3 / k**0.9
