"""Ranking and threshold metrics, computed from one count table of distinct scores.

Every metric reads ``(by, score) -> (pos, n)``, which Spark combines map-side, so a score that
holds a third of the rows is still one small row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.expressions import (
    FOCAL_ALPHA,
    FOCAL_GAMMA,
    loss_column,
    predicted,
    sigmoid,
)
from tallyguard.operators.ordering import quantile_edges, running_totals
from tallyguard.session import durable, partition_target

# Default costs (missed, false alarm), sweep grids in hundredths, and the
# precision floor.
SEARCH_COSTS = (100.0, 10.0)
LOSS_COSTS = (500.0, 20.0)
REVIEW_COSTS = (500.0, 25.0)
SEARCH_GRID = (1, 99)
COST_CURVE_GRID = (2, 98)
PRECISION_FLOOR = 0.95


def score_counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score."""
    return df.groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )


#: Distinct scores, over all groups, whose running sums one task may hold.
FEW_SCORES = 200_000


def counted_scores(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """The score counts as a durable table: the one pass over the rows that a metric makes."""
    return durable(score_counts(df, y, p, by))


def ranked_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, highest first: pos, n, and the running and total counts.

    ``cum_pos`` and ``cum_n`` count rows with a score at least this high. Only with many
    distinct scores is a group cut into ranges, whose edges come from the counts.
    """
    distinct = counts.count()
    pieces = partition_target(counts.sparkSession, distinct) if distinct > FEW_SCORES else 1
    return running_totals(counts, "p", ["pos", "n"], by, True, quantile_edges(counts, "p", pieces))


def ranked_scores(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """The ranked counts of a scored table."""
    return ranked_counts(counted_scores(df, y, p, by), by)


def _ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(otherwise))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2.0 * tp + fp + fn)


def _one_class() -> Column:
    return (F.min("all_pos") == 0) | (F.min("all_pos") == F.min("all_n"))


def _ranking_columns() -> dict[str, Column]:
    """Average precision, ROC area and recall at 95% precision over ranked_scores rows."""
    tp, seen = F.col("cum_pos").cast("double"), F.col("cum_n").cast("double")
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    all_pos, all_neg = F.col("all_pos"), F.col("all_n") - F.col("all_pos")
    precision = tp / seen
    ap = F.sum(_ratio(pos, all_pos) * precision)
    # Trapezoid: this score's negatives times the mean recall before and after it.
    area = F.sum(_ratio((n - pos) * (tp - pos / 2.0), all_pos * all_neg))
    recall = F.max(F.when(precision >= PRECISION_FLOOR, _ratio(tp, all_pos)).otherwise(0.0))
    undefined = F.coalesce(_one_class(), F.lit(True))
    return {
        "pr_auc": F.when(undefined, 0.0).otherwise(ap),
        "roc_auc": F.when(undefined, 0.5).otherwise(area),
        "recall_at_95_precision": F.when(undefined, 0.0).otherwise(recall),
    }


def ranking_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, ROC-AUC and recall at 95% precision; fallbacks for one class."""
    return ranking_of_counts(counted_scores(df, y, p, by), by)


def ranking_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ranking metrics of a table of score counts (``by``, p, pos, n)."""
    ranked = ranked_counts(counts, by)
    return ranked.groupBy(*by).agg(*[c.alias(k) for k, c in _ranking_columns().items()])


def confusion(df: DataFrame, y: str, p: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    hit, positive = predicted(p, threshold) == 1, F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )


def f1_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positive-class F1 and macro F1 from confusion counts.

    The macro mean runs over the labels that occur in the data or in the predictions.
    """
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *by, _f1(tp, fp, fn).alias("fraud_f1"), _macro_f1(tp, fp, tn, fn).alias("macro_f1")
    )


def _macro_f1(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    has_positive = (tp + fp + fn > 0).cast("double")
    has_negative = (tn + fp + fn > 0).cast("double")
    total = has_positive * _f1(tp, fp, fn) + has_negative * _f1(tn, fn, fp)
    return _ratio(total, has_positive + has_negative)


def threshold_sweep(
    df: DataFrame,
    y: str,
    p: str,
    by: Sequence[str] = (),
    grid: tuple[int, int] = SEARCH_GRID,
) -> DataFrame:
    """tp, fp, tn, fn at every threshold of a grid in hundredths, in one pass over the data.

    Each score falls into the cell of the highest grid threshold it reaches; at most a hundred
    cells per group remain, and the counts at a threshold are sums over the cells above it.
    """
    rows = df.select(
        *by,
        F.col(p).cast("double").alias("p"),
        F.col(y).cast("long").alias("pos"),
        F.lit(1).cast("long").alias("n"),
    )
    return _sweep(rows, by, grid)


def _sweep(scores: DataFrame, by: Sequence[str], grid: tuple[int, int]) -> DataFrame:
    low, high = grid
    guess = F.least(F.greatest(F.floor(F.col("p") * 100), F.lit(low - 1)), F.lit(high))
    # floor can miss by one in the last bit; compare with the thresholds themselves.
    cell = (
        F.when((guess < high) & (F.col("p") >= (guess + 1) / F.lit(100.0)), guess + 1)
        .when((guess >= low) & (F.col("p") < guess / F.lit(100.0)), guess - 1)
        .otherwise(guess)
        .cast("int")
    )
    cells = scores.groupBy(*by, cell.alias("cell")).agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n")
    )
    packed = cells.groupBy(*by).agg(
        F.collect_list(F.struct("cell", "pos", "n")).alias("cells"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"),
    )
    steps = packed.withColumn("step", F.explode(F.sequence(F.lit(low), F.lit(high))))

    def at_least(field: str) -> Column:
        return F.aggregate(
            "cells",
            F.lit(0).cast("long"),
            lambda acc, c: acc + F.when(c["cell"] >= F.col("step"), c[field]).otherwise(F.lit(0)),
        )

    swept = steps.select(*by, "step", "all_pos", "all_n", at_least("pos").alias("tp"), at_least("n").alias("hits"))
    return swept.select(
        *by,
        "step",
        (F.col("step") / F.lit(100.0)).alias("threshold"),
        "tp",
        (F.col("hits") - F.col("tp")).alias("fp"),
        (F.col("all_n") - F.col("all_pos") - (F.col("hits") - F.col("tp"))).alias("tn"),
        (F.col("all_pos") - F.col("tp")).alias("fn"),
    )


def best_threshold(
    df: DataFrame,
    y: str,
    p: str,
    by: Sequence[str] = (),
    criterion: str = "f1",
    fn_cost: float = SEARCH_COSTS[0],
    fp_cost: float = SEARCH_COSTS[1],
) -> DataFrame:
    """Threshold with the highest F1 or the lowest cost; the lowest threshold wins ties.

    With fewer than two classes the threshold is 0.5. ``score`` is the F1 or cost there.
    """
    if criterion not in ("f1", "cost"):
        raise ValueError(f"unknown criterion {criterion}")
    return _best(threshold_sweep(df, y, p, by, SEARCH_GRID), by, criterion, fn_cost, fp_cost)


def _best(
    swept: DataFrame, by: Sequence[str], criterion: str, fn_cost: float, fp_cost: float
) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    value = _f1(tp, fp, fn) if criterion == "f1" else fn * F.lit(fn_cost) + fp * F.lit(fp_cost)
    valued = swept.withColumn("value", value)
    best = F.min(F.struct((-F.col("value") if criterion == "f1" else F.col("value")).alias("v"), "step"))
    one_class = F.coalesce((F.max(tp + fn) == 0) | (F.max(fp + F.col("tn")) == 0), F.lit(True))
    half = F.max(F.when(F.col("step") == 50, F.col("value")))
    chosen = valued.groupBy(*by).agg(
        one_class.alias("_one"), best.alias("_best"), half.alias("_half")
    )
    found = F.col("_best.v") if criterion == "cost" else -F.col("_best.v")
    return chosen.select(
        *by,
        (F.when(F.col("_one"), 50).otherwise(F.col("_best.step")) / F.lit(100.0)).alias("threshold"),
        F.when(F.col("_one"), F.col("_half")).otherwise(found).alias("score"),
    )


def metrics_record(
    df: DataFrame,
    y: str,
    p: str,
    by: Sequence[str] = (),
    threshold: float = 0.5,
    optimal_threshold: float | None = None,
) -> DataFrame:
    """All metrics of a score in one row per group.

    Without ``optimal_threshold`` the F1-best one is searched on the same rows. No rows give
    zeros (ROC-AUC and threshold 0.5); one class gives 0 / 0.5 / 0 for the ranking metrics.
    """
    counts = counted_scores(df, y, p, by)
    ranked = ranked_counts(counts, by)
    pos, n, score = F.col("pos"), F.col("n"), F.col("p")

    def parts(cut: float) -> list[Column]:
        hit = predicted(score, cut) == 1
        tp = F.coalesce(F.sum(F.when(hit, pos).otherwise(0)), F.lit(0))
        hits = F.coalesce(F.sum(F.when(hit, n).otherwise(0)), F.lit(0))
        all_pos, all_n = F.coalesce(F.sum(pos), F.lit(0)), F.coalesce(F.sum(n), F.lit(0))
        return [c.cast("double") for c in (tp, hits - tp, all_n - all_pos - hits + tp, all_pos - tp)]

    tp, fp, tn, fn = parts(threshold)
    squared = F.sum(pos * F.pow(1.0 - score, F.lit(2.0)) + (n - pos) * F.pow(score, F.lit(2.0)))
    columns = {
        **_ranking_columns(),
        "macro_f1": _macro_f1(tp, fp, tn, fn),
        "fraud_f1_50": _f1(tp, fp, fn),
        "brier_score": _ratio(squared, F.sum(n)),
    }
    if optimal_threshold is not None:
        otp, ofp, _, ofn = parts(optimal_threshold)
        empty = F.count(F.lit(1)) == 0
        columns["fraud_f1_opt"] = _f1(otp, ofp, ofn)
        columns["optimal_threshold"] = F.when(empty, 0.5).otherwise(F.lit(float(optimal_threshold)))
        record = ranked.groupBy(*by).agg(*[c.alias(k) for k, c in columns.items()])
    else:
        record = ranked.groupBy(*by).agg(*[c.alias(k) for k, c in columns.items()])
        swept = _sweep(counts, by, SEARCH_GRID)
        found = _best(swept, by, "f1", *SEARCH_COSTS).select(
            *by, F.col("score").alias("fraud_f1_opt"), F.col("threshold").alias("optimal_threshold")
        )
        # One row per group on each side: stack and collapse, which also serves an empty ``by``.
        stacked = record.unionByName(found, allowMissingColumns=True)
        names = [c for c in stacked.columns if c not in by]
        record = stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in names])
    return record.select(
        *by,
        "pr_auc",
        "roc_auc",
        "macro_f1",
        F.col("fraud_f1_opt").alias("fraud_f1"),
        "fraud_f1_opt",
        "fraud_f1_50",
        "optimal_threshold",
        "recall_at_95_precision",
        "brier_score",
    )


def financial_loss(
    df: DataFrame,
    y: str,
    p: str,
    threshold: float,
    by: Sequence[str] = (),
    fn_cost: float = LOSS_COSTS[0],
    fp_cost: float = LOSS_COSTS[1],
) -> DataFrame:
    """Cost of missed and false alarms at a threshold, in total and per row."""
    counts = confusion(df, y, p, threshold, by)
    missed, alarms = F.col("fn") * F.lit(fn_cost), F.col("fp") * F.lit(fp_cost)
    rows = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.select(
        *by,
        F.lit(float(threshold)).alias("threshold"),
        (missed + alarms).alias("total_financial_loss"),
        ((missed + alarms) / F.greatest(rows, F.lit(1))).alias("cost_per_transaction"),
        missed.alias("fn_cost"),
        alarms.alias("fp_cost"),
        "tp",
        "fp",
        "tn",
        "fn",
    )


def cost_curve(
    df: DataFrame,
    y: str,
    p: str,
    by: Sequence[str] = (),
    fn_cost: float = REVIEW_COSTS[0],
    fp_cost: float = REVIEW_COSTS[1],
) -> DataFrame:
    """Total, missed and false-alarm cost at 97 thresholds."""
    missed, alarms = F.col("fn") * F.lit(fn_cost), F.col("fp") * F.lit(fp_cost)
    return threshold_sweep(df, y, p, by, COST_CURVE_GRID).select(
        *by,
        "threshold",
        (missed + alarms).alias("total_cost"),
        missed.alias("fn_cost"),
        alarms.alias("fp_cost"),
    )


def cheapest_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First threshold of a cost curve with the lowest total."""
    best = F.min(F.struct("total_cost", "threshold"))
    return curve.groupBy(*by).agg(
        best["threshold"].alias("threshold"), best["total_cost"].alias("total_cost")
    )


def pr_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score, and the end point (1, 0) without one."""
    counts = counted_scores(df, y, p, by)
    ranked = ranked_counts(counts, by)
    points = ranked.select(
        *by,
        F.col("p").alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        # Without positives recall is 1 everywhere by convention.
        _ratio(F.col("cum_pos"), F.col("all_pos"), 1.0).alias("recall"),
    )
    ends = _group_rows(counts, by).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(ends)


def roc_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at each distinct score, and the start point (0, 0)."""
    counts = counted_scores(df, y, p, by)
    ranked = ranked_counts(counts, by)
    negatives = F.col("all_n") - F.col("all_pos")
    points = ranked.select(
        *by,
        F.col("p").alias("threshold"),
        _ratio(F.col("cum_n") - F.col("cum_pos"), negatives).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    starts = _group_rows(counts, by).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(starts)


def _group_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0)


def calibration_table(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean score and positive share per uniform bin; an edge value goes to the lower bin."""
    number = F.lit(0)
    for i in range(1, bins):
        number = number + F.when(F.col(p) > F.lit(i * (1.0 / bins)), 1).otherwise(0)
    return df.groupBy(*by, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(p).cast("double")).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("fraction_positive"),
    )


def class_counts(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    positive = F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count_if(positive).alias("n_pos"),
        F.count_if(F.col(y) == 0).alias("n_neg"),
        F.avg(F.col(y).cast("double")).alias("base_rate"),
    )


def evaluate_logits(
    df: DataFrame,
    y: str,
    logit: str,
    by: Sequence[str] = (),
    loss: str = "focal",
    alpha: float = FOCAL_ALPHA,
    gamma: float = FOCAL_GAMMA,
    positive_weight: float | None = None,
) -> DataFrame:
    """Mean loss, average precision and ROC-AUC of logits.

    One class, no rows, or any NaN logit gives 0 and 0.5 for the two areas.
    """
    label = F.col(y).cast("double")
    value = loss_column(loss, F.col(logit).cast("double"), label, alpha, gamma, positive_weight)
    scored = df.select(*by, y, value.alias("_loss"), sigmoid(F.col(logit).cast("double")).alias("p"))
    # One pass: the losses are added up beside the score counts.
    counts = durable(
        scored.groupBy(*by, "p").agg(
            F.sum(F.col(y).cast("long")).alias("pos"),
            F.count(F.lit(1)).alias("n"),
            F.sum("_loss").alias("losses"),
            F.count("_loss").alias("lossy"),
        )
    )
    summary = counts.groupBy(*by).agg(
        _ratio(F.sum("losses"), F.sum("lossy")).alias("loss"),
        F.coalesce(F.max(F.isnan("p")), F.lit(False)).alias("has_nan"),
    )
    areas = ranking_of_counts(counts, by).select(*by, "pr_auc", "roc_auc")
    stacked = summary.unionByName(areas, allowMissingColumns=True)
    merged = stacked.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("loss", "has_nan", "pr_auc", "roc_auc")]
    )
    return merged.select(
        *by,
        "loss",
        F.when(F.col("has_nan"), 0.0).otherwise(F.col("pr_auc")).alias("pr_auc"),
        F.when(F.col("has_nan"), 0.5).otherwise(F.col("roc_auc")).alias("roc_auc"),
    )
