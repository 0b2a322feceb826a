"""Out-of-time split and purged folds."""

import pytest
from pyspark.sql import functions as F
from tallyguard.operators.folds import PurgedFolds, fold_report, purged_folds
from tallyguard.operators.split import (
    assign_split,
    check_no_lookahead,
    only_split,
    split_audit,
    split_boundaries,
    split_sizes,
    temporal_split,
)


def test_sizes():
    assert split_sizes(1000, 0.8, 0.1, 0.1) == (800, 100)
    # Too few rows for one percent: a tenth each goes to dev and test.
    assert split_sizes(50, 0.98, 0.01, 0.01) == (40, 5)
    assert split_sizes(10, 0.98, 0.01, 0.01) == (8, 1)
    assert split_sizes(9, 0.98, 0.01, 0.01) == (8, 0)
    for bad in [(0.98, 0.05, 0.05), (0.5, 0.2, 0.2)]:
        with pytest.raises(ValueError):
            split_sizes(100, *bad)


@pytest.mark.parametrize("ties", [False, True])
def test_split_equals_sorting(spark, ties):
    keys = [(5 if ties and i % 3 else i * 7 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame([(t, i, int(i % 29 == 0)) for t, i in keys], "t long, id long, y int")
    found = {r["id"]: r["split"] for r in temporal_split(df.repartition(4), "t", "id").collect()}
    ordered = [i for _, i in sorted(keys)]
    expected = {i: "train" if n < 800 else "dev" if n < 900 else "test" for n, i in enumerate(ordered)}
    assert found == expected


def test_audit_and_order_check(spark):
    df = spark.range(1000).select(F.col("id").alias("t"), "id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    parts = temporal_split(df, "t", "id")
    audit = split_audit(parts, "t", "y")
    check_no_lookahead(audit)
    found = {r["split"]: (r["n_rows"], r["min_time"], r["max_time"]) for r in audit.collect()}
    assert found == {"train": (800, 0, 799), "dev": (100, 800, 899), "test": (100, 900, 999)}
    mixed = parts.withColumn("t", F.col("t") % 500)
    with pytest.raises(ValueError):
        check_no_lookahead(split_audit(mixed, "t", "y"))


def test_missing_time_is_an_error(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "t long, id long")
    with pytest.raises(ValueError):
        split_boundaries(df, "t", "id")


def test_one_split_reads_a_range(spark, tmp_path, capsys):
    path = str(tmp_path / "rows")
    spark.range(1000).select(F.col("id").alias("t"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    bounds = split_boundaries(df, "t", "id")
    whole = assign_split(df, bounds, "t", "id")
    for name in ("train", "dev", "test"):
        one = only_split(df, bounds, name, "t", "id")
        assert sorted(one.collect()) == sorted(whole.where(F.col("split") == name).collect())
    only_split(df, bounds, "dev", "t", "id").explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(t,800)" in pushed and "LessThanOrEqual(t,900)" in pushed


def test_split_does_not_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("t"), "id")
    plan = temporal_split(df, "t", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def hourly(spark):
    rows = [(i, "card_A" if 80 <= i < 110 else f"normal{i % 5}" if i < 80 else f"late{i}", i * 3600) for i in range(200)]
    return spark.createDataFrame(rows, "id long, entity string, t long"), rows


@pytest.mark.parametrize("hot", [10**6, 5])
def test_purged_folds_equal_brute_force(spark, hot):
    df, rows = hourly(spark)
    folds = PurgedFolds(n_splits=3)
    found = {}
    for r in purged_folds(df.repartition(3), "id", "entity", "t", folds, hot_rows=hot).collect():
        found.setdefault((r["fold"], r["role"]), set()).add(r["id"])
    for fold, (start, end) in enumerate(folds.edges(0, 199 * 3600)):
        last = fold == 2
        val = {i for i, _, t in rows if start <= t < end or (last and t == end)}
        entities = {e for i, e, _ in rows if i in val}
        train = {i for i, e, t in rows if t < start - 86400 and e not in entities}
        assert found[(fold, "validation")] == val
        assert found.get((fold, "train"), set()) == train
    report = fold_report(df, "id", "entity", "t", folds, hot_rows=hot).collect()
    for r in report:
        assert r["train_rows"] == len(found.get((r["fold"], "train"), ()))
        assert r["validation_rows"] == len(found[(r["fold"], "validation")])
        start = folds.edges(0, 199 * 3600)[r["fold"]][0]
        assert r["train_rows"] + r["purged_rows"] == sum(t < start for _, _, t in rows)


def test_empty_fold_is_left_out(spark):
    rows = [(i, "a", t) for i, t in enumerate([0, 10, 20, 500, 990, 1000])]
    df = spark.createDataFrame(rows, "id long, entity string, t long")
    found = fold_report(df, "id", "entity", "t", PurgedFolds(n_splits=3, purge_buffer_seconds=0.0)).collect()
    assert sorted(r["fold"] for r in found) == [0, 2]


def test_null_entity_is_one_entity(spark):
    rows = [(i, None if i % 2 else f"e{i}", i * 100000) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, entity string, t long")
    train = purged_folds(df, "id", "entity", "t").where("role = 'train'").select("id").distinct()
    assert all(r["id"] % 2 == 0 for r in train.collect())


def test_buffer_units():
    assert PurgedFolds.with_buffer_hours(12).buffer == 43200.0
    assert PurgedFolds(purge_seconds=5.0, purge_buffer_seconds=7.0).buffer == 7.0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, entity string, t long")
    assert purged_folds(empty, "id", "entity", "t").count() == 0
