"""Published versions, carried history, and the benchmark job that can be started again."""

import random

import pytest
from pyspark.sql import functions as F
from tallyguard.models.classifiers import BoostedTrees, CalibratedSvm, Forest
from tallyguard.operators.history import CarriedHistory, carried_windows
from tallyguard.operators.windows import lookback_windows
from tallyguard.plans.benchmark_job import run_benchmark
from tallyguard.sources import ingest
from tallyguard.sources.synthetic import synthetic_tables
from tallyguard.sources.versions import BrokenVersion, MissingVersion, open_version, publish


def test_newest_version_is_read_and_older_ones_stay(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(MissingVersion):
        open_version(spark, path)
    first = publish(spark, path, {"a": spark.range(5), "b": spark.range(0)}, {"x": 1})
    second = publish(spark, path, {"a": spark.range(7)}, {"x": 2}, {"a": []})
    assert (first.number, second.number) == (1, 2)
    newest, older = open_version(spark, path), open_version(spark, path, 1)
    assert newest.parts["a"].count() == 7 and newest.note == {"x": 2}
    assert older.parts["a"].count() == 5 and older.parts["b"].count() == 0
    with pytest.raises(MissingVersion):
        open_version(spark, path, 3)


def test_half_written_versions_are_errors_or_invisible(spark, tmp_path):
    path = str(tmp_path / "v")
    kept = publish(spark, path, {"a": spark.range(5).repartition(2)})

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        bad = spark.range(5).withColumn("x", F.raise_error(F.lit("lost")))
        publish(spark, path, {"a": spark.range(3), "b": bad})
    assert open_version(spark, path).name == kept.name
    # A manifest whose files went away, in part or in whole.
    folder = tmp_path / "v" / kept.name / "a"
    next(p for p in folder.iterdir() if p.name.startswith("part-")).unlink()
    with pytest.raises(BrokenVersion):
        open_version(spark, path)
    (folder / "_SUCCESS").unlink()
    with pytest.raises(BrokenVersion):
        open_version(spark, path)
    (tmp_path / "v/manifests/000000000009.json").write_text('{"version": "x"')
    with pytest.raises(BrokenVersion):
        open_version(spark, path)


@pytest.mark.parametrize("length", [1, 4])
def test_carried_history_equals_one_pass(spark, tmp_path, length):
    rng = random.Random(length)
    rows = [(rng.choice(["a", "b", "c", None, "a"]), t // 3, i, t * 1.5) for i, t in enumerate(range(120))]
    df = spark.createDataFrame(rows, "card string, t long, id long, v double")
    cuts = [df.where("id < 50"), df.where("id >= 50 AND id < 53"), df.where("id >= 53 AND id < 53"), df.where("id >= 53")]
    state = CarriedHistory(spark, str(tmp_path / "s"), "card", "t", "id", ("id", "v"), length)
    found = carried_windows(state, [c.repartition(3) for c in cuts])
    whole = lookback_windows(df, "card", "t", "id", ["id", "v"], length)
    expected = {r["id"]: r["history"] for r in whole.collect()}
    assert {r["id"]: r["history"] for f in found for r in f.collect()} == expected
    held = state.rows().groupBy("card").count().collect()
    assert all(r["count"] <= length - 1 for r in held) and None not in {r["card"] for r in held}
    with pytest.raises(ValueError):
        state.carry(df.where("id < 10"))


def test_job_goes_on_after_a_break(spark, tmp_path):
    transactions, identity = synthetic_tables(spark, 1500, 150)
    merged = ingest.ingest_transactions(transactions, identity).select(
        "TransactionID", "TransactionDT", "card_id", "isFraud", "TransactionAmt", "ProductCD", "D1", "D15"
    )
    models = {
        "GBTClassifier": lambda: BoostedTrees(trees=4, max_depth=3, check_every=2),
        "RandomForest": lambda: Forest(trees=4, max_depth=4),
        "CalibratedSVM": lambda: CalibratedSvm(max_iter=5),
    }
    begun = []

    def breaks(name):
        begun.append(name)
        if name == "predictions_RandomForest" and begun.count(name) == 1:
            raise RuntimeError("executor lost")

    folder = str(tmp_path / "job")

    def run(before):
        made = {name: make() for name, make in models.items()}
        return run_benchmark(merged, folder, "r1", made, clusters=4, before_stage=before)

    with pytest.raises(RuntimeError):
        run(breaks)
    first = begun[:]
    done = run(breaks)
    # Only what was not finished ran again.
    assert begun[len(first)] == "predictions_RandomForest" and set(begun[len(first) :]).isdisjoint(first[:-1])
    again = []
    same = run(again.append)
    assert again == []
    assert same.runs.count() == done.runs.count() == 3
    board = {r["Model"]: r for r in same.leaderboard().collect()}
    assert set(board) == set(models)
    for name, r in board.items():
        assert 0 < r["Model Size (MB)"] < 50 and r["Model Size (MB)"] == same.models[name]["megabytes"]
        assert r["Training Time (s)"] > 0 and r["Latency (ms/sample)"] > 0
    assert same.predictions.groupBy("model").count().where("count = 150").count() == 3
    params = {r["model"]: r["params"] for r in same.runs.collect()}
    assert params["GBTClassifier"]["trees"] == "4" and params["CalibratedSVM"]["max_iter"] == "5"
    # Stored models give the stored predictions.
    restored = models["CalibratedSVM"]().restore(same.models["CalibratedSVM"]["path"])
    stored = {r["TransactionID"]: r["p"] for r in same.predictions.where("model = 'CalibratedSVM'").collect()}
    for r in restored.score(same.points.where("split = 'test'")).collect():
        assert r["p"] == pytest.approx(stored[r["TransactionID"]])
    shown = same.latent_points().collect()
    assert len(shown) == 1500 and {r["Cluster"] for r in shown} <= {f"Cluster {i}" for i in range(4)}
    assert same.points.where("abs(element_at(distances, cluster + 1) - array_min(distances)) > 1e-12").count() == 0
