"""Two-level sketches: accuracy, odd columns, and what their plans move."""

import pytest
from pyspark.sql import functions as F
from tallyguard.operators.correlation import correlation_matrix
from tallyguard.operators.ordering import key_ranges
from tallyguard.operators.sketches import LARGEST, quantiles, rank_error, sketched


@pytest.mark.parametrize("k", [200, 4096, LARGEST])
def test_quantiles_are_within_the_rank_error(spark, k):
    df = spark.range(0, 200_000, 1, 12).select("id", (F.col("id") / 2).alias("x"))
    shares = [0.01, 0.25, 0.5, 0.9]
    found, totals = quantiles(
        df, {"id": F.col("id"), "x": F.col("x")}, {"id": shares, "x": shares}, {"n": F.count(F.lit(1))}, k
    )
    assert totals == {"n": 200_000}
    for share, whole, half in zip(shares, found["id"], found["x"]):
        assert isinstance(whole, int) and abs(whole / 200_000 - share) < 2 * rank_error(k) + 1e-4
        assert abs(half / 100_000 - share) < 2 * rank_error(k) + 1e-4


def test_nulls_nan_and_empty_columns(spark):
    rows = [(1.0, None), (float("nan"), None), (None, None), (3.0, None)]
    df = spark.createDataFrame(rows, "v double, w long")
    found = sketched(df, {"v": F.col("v"), "w": F.col("w")}, {"n": F.count(F.lit(1)), "s": F.sum("w")})
    assert found.totals == {"n": 4, "s": 0}
    assert found.at({"v": [0.0, 1.0], "w": [0.5]}) == {"v": [1.0, 3.0], "w": []}
    assert sketched(df.limit(0), {"v": F.col("v")}).at({"v": [0.5]}) == {"v": []}


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange" in line]


def test_the_last_task_gets_one_row_per_group(spark):
    from tallyguard.operators import sketches

    df = spark.range(0, 1000, 1, 64)
    merged, _ = sketches._merged(df, {"id": F.col("id")}, {}, 200)
    moved = exchanges(merged)
    assert len(moved) == 2 and "SinglePartition" in moved[0] and "hashpartitioning" in moved[1]
    many = correlation_matrix(df.select(*[(F.col("id") * i % 97).cast("double").alias(f"c{i}") for i in range(5)]), [f"c{i}" for i in range(5)])
    moved = exchanges(many)
    # Binary matrices by group of tasks, then one per group.
    assert len(moved) == 2 and all("sums" in e or "REPARTITION" in e for e in moved)


def test_range_numbers_ascend_with_the_keys(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 700L, if(id % 7 = 0, null, id % 1500)) AS t", "id")
    ranges = key_ranges(rows, "t", "id", pieces=12)
    numbered = ranges.numbered(rows, "part").collect()
    order = sorted(numbered, key=lambda r: (r["t"] is None, r["t"] or 0, r["id"]))
    assert [r["part"] for r in order] == sorted(r["part"] for r in numbered)
    assert max(r["part"] for r in numbered) < ranges.count
    sizes = spark.createDataFrame([(r["part"],) for r in numbered], "p int").groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 3 * 30_000 / 12
