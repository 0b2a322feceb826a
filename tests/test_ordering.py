"""Exact selection, numbering, running totals and skew handling against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from tallyguard.operators.ordering import (
    exact_medians,
    global_row_number,
    order_statistics,
    quantile_edges,
    running_totals,
)
from tallyguard.operators.skew import hot_counts, salted_left_join, skewed_left_join


def numbers(kind, n=4000, seed=7):
    rng = random.Random(seed)
    draw = {
        "smooth": lambda: rng.gauss(0, 1e6),
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 3])),
        "outlier": lambda: rng.choice([rng.random(), 1e300, -1e300]),
        "third": lambda: 5.0 if rng.random() < 0.34 else rng.random() * 10,
    }[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["smooth", "ties", "outlier", "third"])
def test_order_statistics_equal_sorting(spark, kind):
    values = numbers(kind)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 9, "v double").repartition(5)
    ranks = [0, 1, 1999, 2000, 3200, 3999]
    # A small gather limit forces several narrowing rounds.
    found = order_statistics(df, {"v": ranks}, gather_rows=10)["v"]
    ordered = sorted(values)
    for r in ranks:
        assert found[r].value == ordered[r]
        assert found[r].below == sum(v < ordered[r] for v in values)
        assert found[r].equal == sum(v == ordered[r] for v in values)


def test_rank_outside_is_an_error(spark):
    with pytest.raises(IndexError):
        order_statistics(spark.createDataFrame([(1.0,)], "v double"), {"v": [1]})


def test_medians(spark):
    rows = [(1.0, None, 4), (2.0, None, 4), (10.0, None, 5), (11.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    assert exact_medians(df, ["a", "b", "c"]) == {"a": 6.0, "b": None, "c": 4.0}
    assert exact_medians(df, []) == {}


@pytest.mark.parametrize("kind", ["spread", "ties", "one_time"])
def test_global_row_number(spark, kind):
    rng = random.Random(3)
    times = {
        "spread": [rng.randrange(10**6) for _ in range(3000)],
        "ties": [50 if rng.random() < 0.4 else rng.randrange(100) for _ in range(3000)],
        "one_time": [7] * 3000,
    }[kind]
    rows = [(t, i * 3) for i, t in enumerate(times)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "t long, id long").repartition(4)
    found = {r["id"]: r["row_number"] for r in global_row_number(df, "t", "id").collect()}
    assert found == {key: i + 1 for i, (_, key) in enumerate(sorted(rows))}


@pytest.mark.parametrize("pieces", [1, 8])
def test_running_totals(spark, pieces):
    rng = random.Random(5)
    rows = [(g, i / 997, rng.randrange(9)) for g in ("a", None, "c") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, p double, n long")
    edges = quantile_edges(df, "p", pieces)
    found = running_totals(df, "p", ["n"], ["g"], True, edges).collect()
    for r in found:
        group = [x for x in rows if x[0] == r["g"]]
        assert r["cum_n"] == sum(x[2] for x in group if x[1] >= r["p"])
        assert r["all_n"] == sum(x[2] for x in group)
    assert len(found) == len(rows)


def test_running_totals_shuffle_once_per_side(spark):
    df = spark.range(100).select((F.col("id") / 100).alias("p"), F.lit(1).alias("n"), F.lit("a").alias("g"))
    plan = running_totals(df, "p", ["n"], ["g"], True, [0.3, 0.6])
    text = plan._jdf.queryExecution().executedPlan().toString()
    # The rows, their range totals, the totals by group, and the totals back by range.
    assert text.count("Exchange hashpartitioning") <= 4


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame(
        [(1 if i % 3 else None if i % 2 else i, i) for i in range(300)], "k long, v long"
    )
    right = spark.createDataFrame([(1, "a"), (1, "b"), (6, "c"), (None, "n")], "k long, w string")
    assert [r["k"] for r in hot_counts(left, "k", 50).collect()] == [1]
    found = salted_left_join(left, right, "k", ["v"], limit=50)
    plain = left.join(right, "k", "left")
    assert sorted(map(repr, found.select("k", "v", "w").collect())) == sorted(
        map(repr, plain.select("k", "v", "w").collect())
    )


@pytest.mark.parametrize("limit", [0, 30, 10**6])
def test_hot_keys_on_either_side(spark, limit):
    rng = random.Random(6)

    def draw():
        return rng.choice([1, 1, 2, None, rng.randrange(40)])

    left = spark.createDataFrame([(draw(), i) for i in range(200)], "k long, v long")
    right = spark.createDataFrame([(draw(), f"w{i}") for i in range(150)], "k long, w string")
    found = skewed_left_join(left, right, "k", ["v"], ["w"], limit=limit)
    plain = left.join(right, "k", "left")
    assert sorted(map(repr, found.select("k", "v", "w").collect())) == sorted(
        map(repr, plain.select("k", "v", "w").collect())
    )


def test_more_hot_keys_than_any_list_holds(spark):
    # Every one of 6,000 keys is hot on both sides, one of them a hundred times over.
    left = spark.range(18_000).selectExpr("id % 6000 AS k", "id AS v").unionByName(
        spark.range(300).selectExpr("7L AS k", "id + 50000 AS v")
    )
    right = spark.range(12_000).selectExpr("id % 6000 AS k", "id AS w")
    assert hot_counts(left, "k", 2).count() == 6000
    found = skewed_left_join(left, right, "k", ["v"], ["w"], limit=1)
    assert found.count() == 36_000 + 600
    assert found.exceptAll(left.join(right, "k", "left")).count() == 0


def test_a_hot_second_has_ranges_of_its_own(spark):
    from tallyguard.operators.ordering import quantile_edges, with_bucket

    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 500L, id % 2000) AS t", "id")
    edges = quantile_edges(rows, "t", 16)
    shape = with_bucket(rows, "t", edges, "b").groupBy("b").agg(
        F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    large = [r for r in shape.collect() if r["n"] > 2 * 40_000 / 16]
    assert [(r["lo"], r["hi"]) for r in large] == [(500, 500)]
    numbered = global_row_number(rows, "t", "id", pieces=16)
    expected = sorted((r["t"], r["id"]) for r in rows.collect())
    assert [(r["t"], r["id"]) for r in sorted(numbered.collect(), key=lambda r: r["row_number"])] == expected


@pytest.mark.parametrize("pieces", [1, 8])
def test_rows_without_time_are_numbered_last(spark, pieces):
    rows = spark.range(1000).selectExpr("if(id % 10 = 0, null, id * 7 % 90) AS t", "id")
    found = global_row_number(rows, "t", "id", pieces=pieces).collect()
    order = sorted(found, key=lambda r: (r["t"] is None, r["t"] or 0, r["id"]))
    assert [r["row_number"] for r in order] == list(range(1, 1001))
