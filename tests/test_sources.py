"""Ingestion, file order, generated rows, predictions, run log and reports."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tallyguard.reports import tables
from tallyguard.session import shared_folder
from tallyguard.sources import files, ingest, runlog
from tallyguard.sources.synthetic import synthetic_tables


def test_downcast_by_name_and_type(spark):
    df = spark.createDataFrame([(1.5, 7, 8, 9, "x")], "amount double, width long, total long, card1 long, note string")
    types = dict(ingest.downcast(df).dtypes)
    assert types == {"amount": "float", "width": "bigint", "total": "int", "card1": "bigint", "note": "string"}


@pytest.mark.parametrize("column,value", [("card1", -1), ("card1", 2**32), ("total", 2**31)])
def test_downcast_rejects_what_does_not_fit(spark, column, value):
    df = spark.createDataFrame([(value,)], f"{column} long")
    with pytest.raises(PySparkException):
        ingest.downcast(df).collect()


def test_join_keeps_and_renames(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "TransactionID long, x string")
    right = spark.createDataFrame([(1, "r1"), (1, "r2"), (9, "r9")], "TransactionID long, x string")
    found = ingest.join_identity(left, right, hot_rows=0)
    assert found.columns == ["TransactionID", "x", "x_right"]
    rows = sorted((r["TransactionID"] or 0, r["x"], r["x_right"] or "") for r in found.collect())
    assert rows == [(0, "c", ""), (1, "a", "r1"), (1, "a", "r2"), (2, "b", "")]


def test_ledger_ids_follow_file_order(spark, tmp_path):
    for part in range(3):
        lines = ["step,nameOrig,isFraud"] + [f"{90 - part * 10 - i},C{part}{i},0" for i in range(5)]
        (tmp_path / f"part{part}.csv").write_text("\n".join(lines) + "\n")
    read = files.read_csv(spark, str(tmp_path), "step long, nameOrig string, isFraud int")
    found = ingest.ingest_ledger(read)
    by_name = {r["nameOrig"]: r["TransactionID"] for r in found.collect()}
    assert by_name == {f"C{p}{i}": p * 5 + i for p in range(3) for i in range(5)}
    with pytest.raises(ValueError):
        ingest.ingest_ledger(read.drop("isFraud"))


def test_ids_do_not_depend_on_how_scans_are_cut(spark, tmp_path):
    for part in range(2):
        spark.range(part * 3000, part * 3000 + 3000, 1, 1).selectExpr("id AS n", "repeat('x', 40) AS pad").coalesce(
            1
        ).write.option("header", True).csv(str(tmp_path / f"in/part{part}"))
    setting, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    paths = [str(tmp_path / f"in/part{part}") for part in range(2)]
    read = spark.read.schema("n long, pad string").option("header", True).csv(paths)
    try:
        spark.conf.set(setting, "20000")
        numbered = files.file_order_id(read, "id")
        spark.conf.set(setting, "70000")
        found = {r["n"]: r["id"] for r in numbered.select("n", "id").collect()}
    finally:
        spark.conf.set(setting, before)
    assert len(found) == 6000 and sorted(found.values()) == list(range(6000))
    assert all(found[n] - found[n - n % 3000] == n % 3000 for n in found)


def test_generated_rows(spark):
    transactions, identity = synthetic_tables(spark, 2000, 100, seed=5)
    assert transactions.count() == 2000 and 300 < identity.count() < 700
    assert {"TransactionID", "isFraud", "TransactionDT", "ProductCD", "C14", "V40"} <= set(transactions.columns)
    ordered = transactions.orderBy("TransactionID").select("TransactionDT").collect()
    times = [r[0] for r in ordered]
    assert times == sorted(times) and times[0] >= 86400 and times[-1] < 86400 * 180
    rate, entities, counts = transactions.agg(F.avg("isFraud"), F.countDistinct("card1", "D1"), F.avg("C1")).first()
    assert 0.005 < rate < 0.06 and entities <= 100 and 1.3 < counts < 1.7
    again = synthetic_tables(spark, 2000, 100, seed=5)[0].repartition(3)
    assert again.exceptAll(transactions).count() == 0


def test_source_choice(spark, tmp_path):
    out = str(tmp_path / "merged")
    ledger = tmp_path / "ledger.csv"
    ledger.write_text("step,nameOrig,isFraud\n3,C1,0\n1,C2,1\n")
    schema = "step long, nameOrig string, isFraud int"
    missing = (str(tmp_path / "none.csv"), "a int")
    found = ingest.run_ingestion(spark, out, missing, None, (str(ledger), schema))
    assert {r["card_id"]: r["TransactionID"] for r in found.collect()} == {"C1": 0, "C2": 1}
    made = ingest.run_ingestion(spark, out + "2", missing, None, missing, synthetic_rows=600)
    assert made.count() == 600 and "card_id" in made.columns


def test_entity_fallbacks(spark):
    df = spark.createDataFrame([(7, 2)], "card1 int, z int")
    assert ingest.with_entity(df).first()["card_id"] == "7"
    assert ingest.with_entity(df.drop("card1")).first()["card_id"] == "entity_0"


def test_prediction_names(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = [("A", 1, 0.5), ("B_Sequence", 0, 0.25)]
    files.write_predictions(spark.createDataFrame(rows, "model string, y int, p double"), path)
    assert files.read_predictions(spark, path, "A_Baseline").first()["p"] == 0.5
    assert files.read_predictions(spark, path, "B").first()["p"] == 0.25
    with pytest.raises(FileNotFoundError):
        files.read_predictions(spark, path, "C")
    # A second write replaces its own models only.
    files.write_predictions(spark.createDataFrame([("A", 1, 0.75)], "model string, y int, p double"), path)
    assert files.read_predictions(spark, path, "A").first()["p"] == 0.75
    assert files.read_predictions(spark, path, "B").first()["p"] == 0.25
    other = str(tmp_path / "by_run")
    files.write_predictions(spark.createDataFrame([("r1", 0.5)], "run string, p double"), other, "run")
    assert files.read_predictions(spark, other, "r1", "run").first()["p"] == 0.5


def test_run_log_keeps_whole_parameters(spark, tmp_path):
    path = str(tmp_path / "runs")
    metrics = spark.createDataFrame([("A", 0.5, None)], "model string, pr_auc double, roc_auc double")
    long_text, nested = "x" * 650, {"deep": {"deeper": [1, 2]}}
    runlog.append_runs(runlog.run_rows(metrics, params={"A": {"note": long_text, "nested": nested}}), path)
    runlog.append_runs(runlog.run_rows(metrics), path)
    stored = runlog.read_runs(spark, path).where("params is not null").first()
    assert stored["params"]["note"] == long_text and '"deeper": [1, 2]' in stored["params"]["nested"]
    assert stored["metrics"] == {"pr_auc": 0.5}
    board = tables.leaderboard(runlog.read_runs(spark, path)).collect()
    assert len(board) == 2 and board[0]["Optimal Threshold"] == 0.5 and board[0]["Model Size (MB)"] == 1.5


def test_service_tiers(spark):
    df = spark.createDataFrame([(1.9,), (2.0,), (10.0,), (30.0,), (51.0,)], "ms double")
    tiers = [r[0] for r in df.select(tables.service_tier("ms")).collect()]
    assert tiers == [
        "In-Flight Card Auth",
        "Near-Line Risk Check",
        "Near-Line Risk Check",
        "unassigned",
        "Post-Auth AML Batch",
    ]


def test_measured_batch_latency_wins(spark):
    schema = "Model string, `PR-AUC` double, `Latency (ms/sample)` double, `Model Size (MB)` double"
    board = spark.createDataFrame([("BiLSTM", 0.5, 2.0, 3.0), ("New", 0.4, 1.0, 1.0)], schema)
    plain = {r["Model"]: r for r in tables.latency_table(board).collect()}
    assert plain["BiLSTM"]["Latency B64 (ms/sample)"] == pytest.approx(0.3)
    assert plain["BiLSTM"]["Architecture"] == "Recurrent" and plain["New"]["Architecture"] == "Neural"
    assert not plain["BiLSTM"]["within_card_limit"] and plain["New"]["within_card_limit"]
    timed = board.withColumn("Latency B64 (ms/sample)", F.lit(0.07))
    assert tables.latency_table(timed).first()["Latency B64 (ms/sample)"] == 0.07


def test_shared_folder_follows_the_session(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark) and spark.sparkContext.getCheckpointDir()


def test_prepared_splits_come_back(spark, tmp_path):
    from tallyguard.operators.preprocess import load_features, transform_features
    from tallyguard.plans.job import prepare_splits

    transactions, identity = synthetic_tables(spark, 600, 60)
    merged = ingest.ingest_transactions(transactions, identity).select(
        "TransactionID", "TransactionDT", "card_id", "isFraud", "TransactionAmt", "ProductCD", "DeviceType"
    )
    splits, state = prepare_splits(merged, str(tmp_path / "prepared"))
    sizes = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    assert sizes == {"train": 480, "dev": 60, "test": 60}
    again = load_features(spark, str(tmp_path / "prepared/features"))
    assert again.feature_names == state.feature_names
    found = transform_features(splits, again)
    assert found.count() == 600 and found.where("num_TransactionAmt is null").count() == 0
    # State comes from train alone: other dev and test rows leave it as it is.
    changed = merged.withColumn(
        "TransactionAmt",
        F.when(F.col("TransactionID") >= 3_000_480, F.lit(1e6)).otherwise(F.col("TransactionAmt")),
    )
    _, other = prepare_splits(changed, str(tmp_path / "changed"))
    assert other.medians == state.medians and other.means == pytest.approx(state.means)
