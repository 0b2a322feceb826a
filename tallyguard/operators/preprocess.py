"""Features fitted on the training rows only and applied to any split as a projection."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.functions.expressions import CYCLICAL, nan_as_null, with_cyclical
from tallyguard.operators.correlation import redundant_columns
from tallyguard.operators.ordering import exact_medians
from tallyguard.operators.skew import HOT_ROWS, salted_left_join
from tallyguard.session import durable, partition_target
from tallyguard.sources.versions import open_version, publish

# Fixed value: the category of a missing text.
MISSING = "MISSING"

INLINE_CATEGORIES = 256


@dataclass
class FeatureState:
    """Everything learned from the training rows."""

    time: str
    entity: str
    row_id: str
    target: str
    numeric: list[str]
    categorical: list[str]
    correlated: list[str] = field(default_factory=list)
    all_null: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    category_counts: dict[str, int] = field(default_factory=dict)
    inline: dict[str, list[str]] = field(default_factory=dict)
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        return [f"num_{c}" for c in self.numeric] + [f"cat_{c}" for c in self.categorical]


def column_kinds(df: DataFrame, excluded: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric (booleans included) and categorical columns, in schema order."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in excluded:
            continue
        is_number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        (numeric if is_number else categorical).append(f.name)
    return numeric, categorical


def metadata_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named columns; one that the table does not have comes back as null."""
    return [
        F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names
    ]


def fit_features(
    train: DataFrame,
    target: str = "isFraud",
    time: str = "TransactionDT",
    entity: str = "card_id",
    row_id: str = "TransactionID",
    correlation_threshold: float = 0.90,
    inline_categories: int = INLINE_CATEGORIES,
) -> FeatureState:
    """Learn kept columns, medians, scaling and category codes from ``train``."""
    rows = nan_as_null(with_cyclical(train, time))
    numeric, categorical = column_kinds(rows, [row_id, time, entity, target, "split"])
    raw = [c for c in numeric if c not in CYCLICAL]
    correlated = redundant_columns(rows, raw, correlation_threshold) if len(raw) > 1 else []
    numeric = [c for c in raw if c not in correlated] + list(CYCLICAL)
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in numeric])

    medians = exact_medians(numbers, numeric)
    all_null = [c for c in numeric if medians[c] is None]
    numeric = [c for c in numeric if c not in all_null]
    means, scales = _fit_scaling(numbers, numeric, medians)

    state = FeatureState(
        time, entity, row_id, target, numeric, categorical, correlated, all_null,
        {c: medians[c] for c in numeric}, means, scales,
    )
    if categorical:
        _fit_categories(rows, state, inline_categories)
    return state


def _fit_scaling(
    numbers: DataFrame, numeric: Sequence[str], medians: dict
) -> tuple[dict[str, float], dict[str, float]]:
    if not numeric:
        return {}, {}
    filled = [F.coalesce(F.col(c), F.lit(medians[c])) for c in numeric]
    row = numbers.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)],
    ).first()
    means = {c: row[f"m{i}"] for i, c in enumerate(numeric)}
    return means, {c: row[f"s{i}"] or 1.0 for i, c in enumerate(numeric)}


def _category(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def _fit_categories(rows: DataFrame, state: FeatureState, inline: int) -> None:
    """Codes by sorted order: the k-th of K categories becomes (k+1)/(K+1).

    One pass counts the categories of all columns, combined map-side.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), _category(c).alias("category")) for c in state.categorical]
    )
    counted = durable(
        rows.select(F.inline(cells)).groupBy("column", "category").agg(F.count(F.lit(1)).alias("count"))
    )
    sizes = {r["column"]: r["n"] for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    state.category_counts = {c: sizes.get(c, 0) for c in state.categorical}
    few = [c for c in state.categorical if state.category_counts[c] <= inline]
    state.inline = {c: [] for c in few}
    # At most ``inline`` rows per column.
    for r in counted.where(F.col("column").isin(few)).select("column", "category").collect():
        state.inline[r["column"]].append(r["category"])
    state.inline = {c: sorted(values) for c, values in state.inline.items()}
    for c in state.categorical:
        if c not in state.inline:
            one = counted.where(F.col("column") == c).drop("column")
            state.dictionaries[c] = durable(_ranked_categories(one))


def _ranked_categories(distinct: DataFrame) -> DataFrame:
    """Exact rank of every category without sorting them all in one task.

    Spark cuts the categories into ranges, as many as their number asks for; the durable copy
    keeps each range's number with its rows.
    """
    pieces = partition_target(distinct.sparkSession, distinct.count())
    ranged = durable(
        distinct.repartitionByRange(pieces, "category").select(
            "category", "count", F.spark_partition_id().alias("piece")
        )
    )
    sizes = ranged.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # One row per range.
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("piece").orderBy("category")
    placed = ranged.withColumn("at", F.row_number().over(inside)).join(offsets, "piece")
    return placed.select("category", "count", (F.col("off") + F.col("at")).alias("rank"))


def transform_features(df: DataFrame, state: FeatureState) -> DataFrame:
    """Row id, time, entity, target (null when absent), split if present, and the features."""
    rows = nan_as_null(with_cyclical(df, state.time))
    for c in state.categorical:
        if c in state.dictionaries:
            dictionary = state.dictionaries[c].select(
                F.col("category").alias(f"_key_{c}"), F.col("rank").alias(f"_rank_{c}")
            )
            keyed = rows.withColumn(f"_key_{c}", _category(c))
            hot = _hot_categories(state, c)
            rows = salted_left_join(keyed, dictionary, f"_key_{c}", [state.row_id], hot)
    meta = metadata_columns(df, [state.row_id, state.time, state.entity, state.target])
    if "split" in df.columns:
        meta.append(F.col("split"))
    scaled = [
        (
            (F.coalesce(F.col(c).cast("double"), F.lit(state.medians[c])) - F.lit(state.means[c]))
            / F.lit(state.scales[c])
        ).alias(f"num_{c}")
        for c in state.numeric
    ]
    coded = []
    for c in state.categorical:
        if c in state.dictionaries:
            position = F.coalesce(F.col(f"_rank_{c}"), F.lit(0))
        else:
            known = F.array(*[F.lit(v) for v in state.inline[c]]).cast("array<string>")
            position = F.array_position(known, _category(c))
        coded.append((position / F.lit(float(state.category_counts[c] + 1))).alias(f"cat_{c}"))
    return rows.select(*meta, *scaled, *coded)


def _hot_categories(state: FeatureState, column: str, limit: int = HOT_ROWS) -> DataFrame:
    """Categories with many rows in training, cut into parts when a dictionary is joined."""
    hot = state.dictionaries[column].where(F.col("count") > limit)
    return hot.select(F.col("category").alias(f"_key_{column}"), F.col("count").alias("n"))


def save_features(state: FeatureState, spark: SparkSession, path: str) -> int:
    """Publish the state as a new version under ``path``; its number.

    One row of JSON holds the scalars; each large category dictionary is a table.
    """
    scalars = {k: v for k, v in vars(state).items() if k != "dictionaries"}
    names = sorted(state.dictionaries)
    body = json.dumps({**scalars, "dictionary_columns": names})
    parts = {"state": spark.createDataFrame([(body,)], "state string")}
    parts |= {f"dictionary_{i}": state.dictionaries[c] for i, c in enumerate(names)}
    return publish(spark, path, parts).number


def load_features(spark: SparkSession, path: str, version: int | None = None) -> FeatureState:
    """The newest complete state under ``path``, or that of a version; anything less is an error."""
    found = open_version(spark, path, version)
    body = json.loads(found.parts["state"].first()["state"])
    names = body.pop("dictionary_columns")
    state = FeatureState(**body)
    state.dictionaries = {c: found.parts[f"dictionary_{i}"] for i, c in enumerate(names)}
    return state
