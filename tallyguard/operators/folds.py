"""Purged, entity-disjoint time-series cross-validation as one plan for all folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.ordering import global_row_number
from tallyguard.operators.skew import HOT_ROWS, salted_left_join
from tallyguard.session import durable


# Default fold settings.
FOLDS = 5
FIRST_TRAIN_SHARE = 0.4
PURGE_SECONDS = 86400.0


@dataclass(frozen=True)
class PurgedFolds:
    """Fold settings. ``purge_buffer_seconds``, when given, replaces ``purge_seconds``."""

    n_splits: int = FOLDS
    min_train_ratio: float = FIRST_TRAIN_SHARE
    purge_seconds: float = PURGE_SECONDS
    purge_buffer_seconds: float | None = None

    @property
    def buffer(self) -> float:
        if self.purge_buffer_seconds is not None:
            return float(self.purge_buffer_seconds)
        return float(self.purge_seconds)

    @classmethod
    def with_buffer_hours(cls, hours: float, **settings) -> "PurgedFolds":
        return cls(purge_buffer_seconds=hours * 3600.0, **settings)

    def edges(self, first: float, last: float) -> list[tuple[float, float]]:
        """[start, end) of each validation fold over the time span."""
        span = last - first
        step = (1.0 - self.min_train_ratio) / self.n_splits
        starts = [self.min_train_ratio + fold * step for fold in range(self.n_splits)]
        return [(first + s * span, first + (s + step) * span) for s in starts]


#: Folds whose numbers fit the bits of a long.
MOST_FOLDS = 62


def _bits(conditions: Sequence[Column]) -> Column:
    """A long whose i-th bit says whether the i-th condition holds."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0)).cast("long")


def _has(bits: str, fold: int) -> Column:
    return F.col(bits).bitwiseAND(F.lit(1 << fold).cast("long")) != 0


@dataclass(frozen=True)
class _Plan:
    """What the folds need besides the rows: edges, live folds, and one row per entity."""

    edges: list[tuple[float, float]]
    live: list[bool]
    entities: DataFrame  # entity, seen (bits), n; the null entity left out
    null_seen: int

    def validates(self, t: Column) -> list[Column]:
        """Per fold whether a row at time ``t`` lies in its validation part."""
        final = len(self.edges) - 1
        return [
            (t >= start) & ((t <= end) if i == final else (t < end)) for i, (start, end) in enumerate(self.edges)
        ]


def _cells(rows: DataFrame, width: float) -> DataFrame:
    """Rows, first and last time per entity and time bucket: one small table for all questions."""
    bucket = F.floor(F.col("t") / F.lit(float(width)))
    return durable(
        rows.groupBy("entity", bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")
        )
    )


def _planned(rows: DataFrame, folds: PurgedFolds) -> _Plan:
    """Count the rows per (entity, time bucket) once and answer everything else from that.

    A bucket narrower than a fold holds at most one fold edge, so the folds of its first and of
    its last row are the folds of all its rows, and an entity's validation folds are exact.
    """
    if folds.n_splits > MOST_FOLDS:
        raise ValueError(f"at most {MOST_FOLDS} folds, got {folds.n_splits}")
    cells = _cells(rows, folds.buffer if folds.buffer > 0 else PURGE_SECONDS)
    first, last = cells.agg(F.min("lo"), F.max("hi")).first()
    if first is None:
        return _Plan([], [], cells.select("entity", F.lit(0).cast("long").alias("seen"), "n").limit(0), 0)
    edges = folds.edges(first, last)
    narrowest = min(end - start for start, end in edges)
    if narrowest > 0 and narrowest < (folds.buffer if folds.buffer > 0 else PURGE_SECONDS):
        # The whole span is short; now that it is known, count again in narrower buckets.
        cells = _cells(rows, narrowest / 2)
    plan = _Plan(edges, [], cells, 0)
    touched = _bits(plan.validates(F.col("lo"))).bitwiseOR(_bits(plan.validates(F.col("hi"))))
    entities = durable(
        cells.groupBy("entity").agg(F.bit_or(touched).alias("seen"), F.sum("n").alias("n"))
    )
    null_bits = F.bit_or(F.when(F.col("entity").isNull(), F.col("seen")))
    # A fold without validation rows is left out altogether.
    every, null_seen = entities.agg(F.bit_or("seen"), null_bits).first()
    live = [bool(every >> i & 1) for i in range(len(edges))]
    return _Plan(edges, live, entities.where(F.col("entity").isNotNull()), null_seen or 0)


def _assigned(
    df: DataFrame, row_id: str, entity: str, time: str, folds: PurgedFolds, hot_rows: int
) -> tuple[DataFrame, int]:
    """(id, validates, precedes, trains) as fold bits per row, and the number of folds.

    Rows meet a table of one row per entity once, instead of one copy per fold meeting a
    (fold, entity) table. The join is salted for entities with many rows.
    """
    rows = df.select(
        F.col(row_id).alias("id"), F.col(entity).alias("entity"), F.col(time).cast("double").alias("t")
    )
    plan = _planned(rows, folds)
    t = F.col("t")
    marked = rows.select(
        "id",
        "entity",
        _bits(plan.validates(t)).alias("validates"),
        _bits([F.lit(on) & (t < start) for on, (start, _) in zip(plan.live, plan.edges)]).alias("precedes"),
        _bits(
            [F.lit(on) & (t < start - folds.buffer) & (t < start) for on, (start, _) in zip(plan.live, plan.edges)]
        ).alias("trains"),
    )
    hot = plan.entities.where(F.col("n") > hot_rows).select("entity", "n")
    joined = salted_left_join(marked, plan.entities.select("entity", "seen"), "entity", ["id"], hot, hot_rows)
    # Null is one entity like any other here, but has no key that joins.
    seen = F.when(F.col("entity").isNull(), F.lit(plan.null_seen)).otherwise(F.coalesce("seen", F.lit(0)))
    return joined.select(
        "id", "validates", "precedes", F.col("trains").bitwiseAND(F.bitwise_not(seen.cast("long"))).alias("trains")
    ), len(plan.edges)


def purged_folds(
    df: DataFrame,
    row_id: str,
    entity: str,
    time: str,
    folds: PurgedFolds = PurgedFolds(),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(fold, role, id) for every fold; role is ``train`` or ``validation``.

    Training rows lie before the fold start minus the buffer and belong to no entity of the
    fold's validation part.
    """
    rows, n = _assigned(df, row_id, entity, time, folds, hot_rows)
    parts = [
        F.when(_has(bits, i), F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role")))
        for i in range(n)
        for role, bits in (("validation", "validates"), ("train", "trains"))
    ]
    kept = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<struct<fold:int,role:string>>")
    return rows.select(F.inline(kept), "id")


def fold_report(
    df: DataFrame,
    row_id: str,
    entity: str,
    time: str,
    folds: PurgedFolds = PurgedFolds(),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per fold: training rows, rows removed by buffer or entity, validation rows."""
    rows, n = _assigned(df, row_id, entity, time, folds, hot_rows)
    names = ("train_rows", "purged_rows", "validation_rows")
    counts = [
        F.count_if(c).alias(f"{name}_{i}")
        for i in range(n)
        for name, c in zip(
            names, (_has("trains", i), _has("precedes", i) & ~_has("trains", i), _has("validates", i))
        )
    ]
    lines = [F.struct(F.lit(i).alias("fold"), *[F.col(f"{name}_{i}").alias(name) for name in names]) for i in range(n)]
    kind = "array<struct<fold:int,train_rows:bigint,purged_rows:bigint,validation_rows:bigint>>"
    listed = F.array(*lines) if lines else F.array().cast(kind)
    # A fold without any row has no line, as a fold without validation rows trains on nothing.
    return rows.agg(F.count(F.lit(1)).alias("_n"), *counts).select(F.inline(listed)).where(
        "train_rows + purged_rows + validation_rows > 0"
    )


def with_row_time(df: DataFrame, time: str, tie: str, name: str = "row_time") -> DataFrame:
    """Row position as the time axis, for tables without a usable timestamp.

    The folds read their rows several times, so the numbered rows are written once.
    """
    return durable(global_row_number(df, time, tie, name).withColumn(name, F.col(name) - 1))
