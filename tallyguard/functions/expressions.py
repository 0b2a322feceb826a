"""Scalar expressions on times, keys, scores and logits."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Time units, texts of missing key parts, focal loss defaults and limits, and the
# positive weight used when none is given.
SECONDS_PER_DAY = 86400.0
SECONDS_PER_HOUR = 3600.0
MISSING_TEXT = "UNK"
MISSING_NUMBER = "0"
MISSING_FLOAT = "0.0"
FOCAL_ALPHA = 0.75
FOCAL_GAMMA = 2.0
PROBABILITY_MARGIN = 1e-6
DEFAULT_POSITIVE_WEIGHT = 27.5
CYCLICAL = ("hour_sin", "hour_cos", "day_sin", "day_cos")


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp column (session zone UTC)."""
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def with_cyclical(df: DataFrame, time: str) -> DataFrame:
    """Hour-of-day and day-of-week as points on a circle. ``time`` is elapsed seconds."""
    t = F.col(time).cast("double")
    hour = F.pmod(t, F.lit(SECONDS_PER_DAY)) / SECONDS_PER_HOUR
    day = F.pmod(t / SECONDS_PER_DAY, F.lit(7.0))
    hour_angle = hour * (2.0 * math.pi / 24.0)
    day_angle = day * (2.0 * math.pi / 7.0)
    return df.withColumns(
        {
            "hour_sin": F.sin(hour_angle),
            "hour_cos": F.cos(hour_angle),
            "day_sin": F.sin(day_angle),
            "day_cos": F.cos(day_angle),
        }
    )


def plain_number(column: str, dtype: T.DataType) -> Column:
    """Text of a number without exponent: 150.0 prints as ``150.0``, also beyond 1e7."""
    text = F.col(column).cast("string")
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return text
    # The shortest digits that read back as the same number, moved by the exponent.
    part = lambda i: F.regexp_extract(text, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", i)
    power = part(4).cast("int")
    tail = F.when(part(3) == "0", F.lit("")).otherwise(part(3))
    small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), -power - 1), part(2), tail)
    longer = F.length(tail) > power
    whole = F.rpad(F.concat(part(2), tail), power + 1, "0")
    rest = F.when(longer, F.substring(tail, power + 1, F.length(tail))).otherwise(F.lit("0"))
    large = F.concat(part(1), whole, F.lit("."), rest)
    return F.when(part(4) == "", text).when(power < 0, small).otherwise(large)


def entity_key(df: DataFrame, parts: list[str]) -> Column:
    """Parts joined with ``_``. A null number becomes 0, a null text becomes ``UNK``."""
    pieces = []
    for part in parts:
        dtype = df.schema[part].dataType
        if isinstance(dtype, T.StringType):
            pieces.append(F.coalesce(F.col(part), F.lit(MISSING_TEXT)))
        else:
            is_float = isinstance(dtype, (T.FloatType, T.DoubleType))
            zero = MISSING_FLOAT if is_float else MISSING_NUMBER
            pieces.append(F.coalesce(plain_number(part, dtype), F.lit(zero)))
    return F.concat_ws("_", *pieces)


def predicted(p: str | Column, threshold: float | Column) -> Column:
    """1 when the score reaches the threshold (inclusive), else 0."""
    score = F.col(p) if isinstance(p, str) else p
    return F.when(score >= threshold, 1).otherwise(0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_loss_of_logit(logit: Column, y: Column, positive_weight: float = 1.0) -> Column:
    """Binary cross entropy on a logit; the positive term is multiplied by the weight.

    Written with log(1+exp(-|x|)), which stays finite for any finite logit.
    """
    softplus_negative = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    softplus_positive = F.log1p(F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0))
    return F.lit(float(positive_weight)) * y * softplus_negative + (1.0 - y) * softplus_positive


def focal_loss_of_logit(
    logit: Column, y: Column, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA
) -> Column:
    """Binary focal loss on a logit; p is kept in [1e-6, 1-1e-6] and 1-p_t above 1e-6."""
    low, high = F.lit(PROBABILITY_MARGIN), F.lit(1.0 - PROBABILITY_MARGIN)
    p = F.least(F.greatest(sigmoid(logit), low), high)
    p_true = p * y + (1.0 - p) * (1.0 - y)
    class_weight = F.lit(alpha) * y + F.lit(1.0 - alpha) * (1.0 - y)
    focus = F.pow(F.greatest(1.0 - p_true, F.lit(PROBABILITY_MARGIN)), F.lit(float(gamma)))
    return class_weight * focus * log_loss_of_logit(logit, y)


def loss_column(
    kind: str,
    logit: Column,
    y: Column,
    alpha: float = FOCAL_ALPHA,
    gamma: float = FOCAL_GAMMA,
    positive_weight: float | None = None,
) -> Column:
    """``focal``, ``weighted_bce``, or plain cross entropy for any other name."""
    if kind == "focal":
        return focal_loss_of_logit(logit, y, alpha, gamma)
    if kind == "weighted_bce":
        weight = DEFAULT_POSITIVE_WEIGHT if positive_weight is None else positive_weight
        return log_loss_of_logit(logit, y, weight)
    return log_loss_of_logit(logit, y)


def lookup(column: str, table: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.lit(default))


def nan_as_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Float NaN becomes NULL, so medians, means and counts skip it."""
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
        and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
