"""Class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.expressions import DEFAULT_POSITIVE_WEIGHT
from tallyguard.operators.metrics import class_counts


def positive_weight(n_pos: Column, n_neg: Column, given: float | None = None) -> Column:
    """Negatives per positive; the default without positives; a given weight wins."""
    if given is not None:
        return F.lit(float(given))
    return F.when(n_pos > 0, n_neg / F.greatest(n_pos, F.lit(1))).otherwise(F.lit(DEFAULT_POSITIVE_WEIGHT))


def class_weight_table(df: DataFrame, y: str, given: float | None = None) -> DataFrame:
    """One row: counts, the positive weight, and the balanced weight n / (2 n_c) of each class."""
    pos, neg = F.col("n_pos"), F.col("n_neg")
    both = (pos + neg).cast("double")
    return class_counts(df, y).select(
        "n_pos",
        "n_neg",
        positive_weight(pos, neg, given).alias("positive_weight"),
        (both / F.nullif(2 * pos, F.lit(0))).alias("balanced_pos"),
        (both / F.nullif(2 * neg, F.lit(0))).alias("balanced_neg"),
    )


def with_weight(df: DataFrame, y: str, scheme: str, given: float | None = None, name: str = "weight") -> DataFrame:
    """Row weights: ``positive`` weighs only positives, ``balanced`` both classes."""
    table = class_weight_table(df, y, given).first()
    if scheme == "positive":
        high, low = table["positive_weight"], 1.0
    else:
        high, low = table["balanced_pos"] or 1.0, table["balanced_neg"] or 1.0
    return df.withColumn(name, F.when(F.col(y) == 1, F.lit(high)).otherwise(F.lit(low)))
