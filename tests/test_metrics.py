"""Metrics, thresholds, costs and curves on small exact cases and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tallyguard.functions.expressions import loss_column
from tallyguard.operators import metrics


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


# Three positives above every negative, the gap from 0.44 to 0.62; two negatives share a score.
SEPARABLE = ([0, 1, 0, 0, 1, 0, 1], [0.12, 0.97, 0.44, 0.03, 0.62, 0.12, 0.71])


def test_separable_scores(spark):
    record = metrics.metrics_record(frame(spark, *SEPARABLE), "y", "p").first()
    assert record["pr_auc"] == 1.0 and record["roc_auc"] == 1.0
    assert record["fraud_f1"] == 1.0 and record["recall_at_95_precision"] == 1.0
    assert record["brier_score"] < 0.1
    # The lowest threshold that separates wins the tie.
    assert record["optimal_threshold"] == 0.45


def test_cost_of_unequal_cells(spark):
    rows = frame(spark, [1, 1, 1, 0, 0, 0, 0, 0], [0.7, 0.2, 0.3, 0.7, 0.6, 0.6, 0.1, 0.4])
    found = metrics.financial_loss(rows, "y", "p", 0.6, fn_cost=80.0, fp_cost=3.0).first()
    assert [found[c] for c in ("tp", "fn", "fp", "tn")] == [1, 2, 3, 2]
    assert found["total_financial_loss"] == 169.0 and found["cost_per_transaction"] == 169.0 / 8


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(spark, label):
    rows = frame(spark, [label] * 20, [0.01 + i * 0.02 for i in range(20)])
    record = metrics.metrics_record(rows, "y", "p").first()
    assert record["pr_auc"] == 0.0 and record["roc_auc"] == 0.5
    assert record["recall_at_95_precision"] == 0.0 and record["optimal_threshold"] == 0.5
    assert record["fraud_f1"] == 0.0
    assert record["macro_f1"] == (1.0 if label == 0 else 0.0)


def test_no_rows(spark):
    empty = frame(spark, [1], [0.5]).where("p > 1")
    record = metrics.metrics_record(empty, "y", "p").first().asDict()
    assert record.pop("roc_auc") == 0.5 and record.pop("optimal_threshold") == 0.5
    assert set(record.values()) == {0.0}
    loss = metrics.financial_loss(empty, "y", "p", 0.5).first()
    assert loss["total_financial_loss"] == 0.0 and loss["cost_per_transaction"] == 0.0
    fixed = metrics.metrics_record(empty, "y", "p", optimal_threshold=0.3).first()
    assert fixed["optimal_threshold"] == 0.5


def brute(y, p):
    cuts = sorted(set(p), reverse=True)
    positives, negatives = sum(y), len(y) - sum(y)
    ap, previous, recall95 = 0.0, 0.0, 0.0
    for c in cuts:
        hit = [a for a, b in zip(y, p) if b >= c]
        recall, precision = sum(hit) / positives, sum(hit) / len(hit)
        ap += (recall - previous) * precision
        previous = recall
        recall95 = max(recall95, recall if precision >= 0.95 else 0.0)
    pairs = [(a, b) for a, la in zip(p, y) if la for b, lb in zip(p, y) if not lb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / (positives * negatives)
    return ap, auc, recall95


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_areas_equal_brute_force(spark, digits, monkeypatch):
    rng = random.Random(digits)
    y = [int(rng.random() < 0.2) for _ in range(300)]
    p = [round(min(1.0, max(0.0, rng.gauss(0.4 + 0.3 * a, 0.2))), digits) for a in y]
    expected = brute(y, p)
    rows = frame(spark, y, p).repartition(4)

    def areas():
        found = metrics.ranking_metrics(rows, "y", "p").first()
        return [found[c] for c in ("pr_auc", "roc_auc", "recall_at_95_precision")]

    assert areas() == pytest.approx(expected)
    # The same with score ranges.
    monkeypatch.setattr(metrics, "FEW_SCORES", 10)
    assert areas() == pytest.approx(expected)


def test_sweep_puts_scores_on_the_right_side(spark):
    p = [i / 100 for i in range(101)] + [math.nextafter(0.29, 0), math.nextafter(0.57, 1), 0.999]
    rows = frame(spark, [i % 2 for i in range(len(p))], p)
    for row in metrics.threshold_sweep(rows, "y", "p").collect():
        hits = [i % 2 for i, v in enumerate(p) if v >= row["threshold"]]
        assert row["tp"] == sum(hits) and row["fp"] == len(hits) - sum(hits)
        assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == len(p)


def test_cost_criterion(spark):
    rows = frame(spark, *SEPARABLE)
    found = metrics.best_threshold(rows, "y", "p", criterion="cost").first()
    assert (found["threshold"], found["score"]) == (0.45, 0.0)
    with pytest.raises(ValueError):
        metrics.best_threshold(rows, "y", "p", criterion="gain")


def test_cost_curve_has_97_points(spark):
    curve = metrics.cost_curve(frame(spark, *SEPARABLE), "y", "p")
    rows = curve.collect()
    assert len(rows) == 97 and min(r["total_cost"] for r in rows) >= 0
    assert metrics.cheapest_threshold(curve).first()["threshold"] == 0.45


def test_calibration_edges(spark):
    rows = frame(spark, [0, 1, 1, 0], [0.1, 0.10000001, 1.0, 0.0])
    found = {r["bin"]: r["n"] for r in metrics.calibration_table(rows, "y", "p").collect()}
    assert found == {0: 2, 1: 1, 9: 1}


def test_curve_end_points(spark):
    rows = frame(spark, *SEPARABLE)
    pr = metrics.pr_curve(rows, "y", "p").collect()
    assert len(pr) == 7 and any(r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)
    roc = metrics.roc_curve(rows, "y", "p").collect()
    assert any(r["fpr"] == 0.0 and r["tpr"] == 0.0 for r in roc)
    assert any(r["fpr"] == 1.0 and r["tpr"] == 1.0 for r in roc)


def test_losses_stay_finite(spark):
    rows = spark.createDataFrame(
        [(-700.0, 0.0), (90.0, 1.0), (0.0, 1.0), (-30.0, 1.0), (20.0, 0.0), (640.0, 1.0)], "x double, y double"
    )
    value = loss_column("focal", F.col("x"), F.col("y"))
    total, mean, low = rows.agg(F.sum(value), F.avg(value), F.min(value)).first()
    assert math.isfinite(total) and low >= 0 and total == pytest.approx(6 * mean)
    plain = rows.agg(F.sum(loss_column("anything", F.col("x"), F.col("y")))).first()[0]
    assert plain == pytest.approx(math.log(2) + 50.0)
    weighted = rows.agg(F.sum(loss_column("weighted_bce", F.col("x"), F.col("y")))).first()[0]
    assert weighted == pytest.approx(27.5 * (math.log(2) + 30) + 20)


def test_nan_logits_give_fallbacks(spark):
    rows = spark.createDataFrame([(1, 2.0), (0, float("nan")), (0, -1.0)], "y int, x double")
    found = metrics.evaluate_logits(rows, "y", "x").first()
    assert found["pr_auc"] == 0.0 and found["roc_auc"] == 0.5


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    y = [int(rng.random() < 0.3) for _ in range(500)]
    rows = frame(spark, y, [round(rng.random(), 2) for _ in y])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            record = metrics.metrics_record(rows.repartition(int(n)), "y", "p").first()
            seen.append([round(v, 12) for v in record])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
