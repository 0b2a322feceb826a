"""Model contracts: probabilities, weights, calibration, early stopping, saving."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from tallyguard.models import classifiers, large_forest
from tallyguard.models.classifiers import (
    BoostedTrees,
    CalibratedSvm,
    Forest,
    NotFitted,
    SequenceNetwork,
    _stop_early,
    flat_window,
)
from tallyguard.models.search import draw_settings
from tallyguard.models.weights import class_weight_table, with_weight
from tallyguard.operators.latent import as_vector
from tallyguard.operators.metrics import ranking_metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = (rng.random(400) < 0.15).astype(int)
    x[y == 1] += 1.5
    data = [(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = as_vector(spark.createDataFrame(data, "TransactionID long, isFraud int, v array<double>"), "v")
    return df.drop("v").persist()


MODELS = [
    lambda: BoostedTrees(trees=3, max_depth=3),
    lambda: Forest(trees=5, max_depth=4),
    lambda: CalibratedSvm(max_iter=5),
    lambda: SequenceNetwork(hidden=(4,), max_iter=5),
]


@pytest.mark.parametrize("make", MODELS)
def test_scores_are_probabilities_and_survive_saving(rows, make, tmp_path):
    train, later = rows.where("TransactionID < 300"), rows.where("TransactionID >= 300")
    model = make()
    with pytest.raises(NotFitted):
        model.score(later)
    with pytest.raises(NotFitted):
        model.save(str(tmp_path / "m"))
    scored = model.fit(train).score(later).orderBy("TransactionID").collect()
    assert len(scored) == 100 and all(0.0 <= r["p"] <= 1.0 for r in scored)
    assert {r["prediction"] for r in scored} <= {0.0, 1.0}
    model.save(str(tmp_path / "m"))
    again = make().restore(str(tmp_path / "m")).score(later).orderBy("TransactionID").collect()
    assert [r["p"] for r in again] == pytest.approx([r["p"] for r in scored])


def test_models_learn(rows):
    for make in MODELS[:3]:
        scored = make().fit(rows).score(rows)
        assert ranking_metrics(scored, "isFraud", "p").first()["roc_auc"] > 0.8


def test_early_stopping_counts():
    rising = [(i, i / 100) for i in range(10, 60, 10)]
    assert _stop_early(rising, 20) == 50
    assert _stop_early([(10, 0.5), (20, 0.4), (30, 0.4), (40, 0.9)], 20) == 10
    assert _stop_early([(10, 0.5), (20, 0.4), (30, 0.6), (40, 0.6)], 20) == 30


def test_dev_rows_choose_the_tree_count(rows):
    model = BoostedTrees(trees=6, max_depth=3, check_every=2, patience=2)
    model.fit(rows.where("TransactionID < 250"), rows.where("TransactionID >= 250"))
    assert model.best_trees in (2, 4, 6) and len(model.model.trees) == model.best_trees


def test_staged_curve_equals_a_plain_loop(rows, monkeypatch):
    train, dev = rows.where("TransactionID < 250"), rows.where("TransactionID >= 250")
    model = BoostedTrees(trees=7, max_depth=3, check_every=2)
    labelled = train.selectExpr("features", "cast(isFraud as double) AS label", "1.0 AS weight")
    grown = model._train(labelled, 7)
    for held in (classifiers.HELD_SCORES, 5):
        monkeypatch.setattr(classifiers, "HELD_SCORES", held)
        found = dict(model.dev_curve(grown, dev.repartition(3)))
        assert sorted(found) == [2, 4, 6, 7]
        for count, area in found.items():
            cut = classifiers.first_trees(grown, count)
            scored = BoostedTrees(model=cut).score(dev)
            assert len(cut.trees) == count and cut.treeWeights == grown.treeWeights[:count]
            assert area == pytest.approx(ranking_metrics(scored, "isFraud", "p").first()["pr_auc"])


def test_cut_model_equals_a_shorter_training(rows, tmp_path):
    labelled = rows.selectExpr("features", "cast(isFraud as double) AS label", "1.0 AS weight")
    model = BoostedTrees(trees=6, max_depth=3)
    cut, short = classifiers.first_trees(model._train(labelled, 6), 3), model._train(labelled, 3)
    a, b = (
        [r["p"] for r in BoostedTrees(model=m).score(rows).orderBy("TransactionID").collect()] for m in (cut, short)
    )
    assert a == pytest.approx(b)
    # A cut model is stored and read like any other.
    BoostedTrees(model=cut).save(str(tmp_path / "cut"))
    again = BoostedTrees().restore(str(tmp_path / "cut")).score(rows).orderBy("TransactionID").collect()
    assert [r["p"] for r in again] == pytest.approx(a)


def weights(spark, pos, neg, given=None):
    df = spark.createDataFrame([(1,)] * pos + [(0,)] * neg, "y int")
    return class_weight_table(df, "y", given).first()


def test_class_weights(spark):
    assert weights(spark, 5, 45)["positive_weight"] == 9.0
    assert weights(spark, 5, 45, 15.5)["positive_weight"] == 15.5
    assert weights(spark, 0, 50)["positive_weight"] == 27.5
    found = weights(spark, 5, 45)
    assert found["balanced_pos"] == 5.0 and found["balanced_neg"] == pytest.approx(50 / 90)


def test_search_space():
    drawn = draw_settings(50, seed=1)
    assert drawn == draw_settings(50, seed=1) and drawn != draw_settings(50, seed=2)
    for s in drawn:
        assert 4 <= s["max_depth"] <= 10 and 0.01 <= s["learning_rate"] <= 0.2
        assert 0.6 <= s["subsample"] <= 1.0 and 10.0 <= s["positive_weight"] <= 35.0


def test_sequence_network_separates_windows(spark):
    rng = random.Random(9)
    data = []
    for i in range(32):
        shift = 2.0 if i < 16 else 0.0
        steps = [[0.0] * 16 for _ in range(4)] + [[rng.gauss(shift, 1) for _ in range(16)] for _ in range(6)]
        data.append((i, int(i < 16), steps, [True] * 4 + [False] * 6))
    schema = "TransactionID long, isFraud int, window array<array<double>>, padding_mask array<boolean>"
    df = spark.createDataFrame(data, schema).withColumn("features", flat_window())
    assert len(df.first()["features"]) == 170
    scored = SequenceNetwork(hidden=(8,), max_iter=40).fit(df).score(df)
    assert ranking_metrics(scored, "isFraud", "p").first()["roc_auc"] >= 0.95


def test_svm_folds_are_fitted_side_by_side(rows, monkeypatch):
    alone = CalibratedSvm(max_iter=5)
    parts = rows.selectExpr("features", "cast(isFraud as double) AS label", "TransactionID")
    fold = "cast(pmod(xxhash64(TransactionID, 42), 3) as int) AS fold"
    wanted = [alone._fit_fold(parts.selectExpr("*", fold), i) for i in range(3)]
    meet, plain = threading.Barrier(3, timeout=60), CalibratedSvm._fit_fold

    def fit_fold(self, *given):
        meet.wait()
        return plain(self, *given)

    monkeypatch.setattr(CalibratedSvm, "_fit_fold", fit_fold)
    found = CalibratedSvm(max_iter=5).fit(rows).pairs
    for (svm, platt), (svm_alone, platt_alone) in zip(found, wanted, strict=True):
        assert svm.coefficients.toArray() == pytest.approx(svm_alone.coefficients.toArray(), rel=1e-9)
        assert platt.coefficients.toArray() == pytest.approx(platt_alone.coefficients.toArray(), rel=1e-6)


def test_a_forest_that_remembers_nodes_grows_the_same_trees(rows):
    remembering = Forest(trees=5, max_depth=6).fit(rows).model
    weighted = with_weight(rows.selectExpr("features", "cast(isFraud as double) AS label"), "label", "balanced")
    plain = RandomForestClassifier(numTrees=5, maxDepth=6, minInstancesPerNode=4, weightCol="weight", seed=42)
    walking = plain.fit(weighted)
    assert remembering.getCacheNodeIds() and not walking.getCacheNodeIds()
    body = [m.toDebugString.split("\n", 1)[1] for m in (remembering, walking)]
    assert body[0] == body[1]


def test_bin_edges():
    one = np.ones(1000)
    assert large_forest.bin_edges(np.array([3.0, 1.0, 1.0, np.nan]), one[:4]).tolist() == [2.0]
    assert large_forest.bin_edges(np.full(5, 7.0), one[:5]).tolist() == []
    edges = large_forest.bin_edges(np.arange(1000.0), one)
    shares = np.diff(np.searchsorted(np.arange(1000.0), [-1, *edges, 1000]))
    assert len(edges) == 31 and min(shares) >= 30 and max(shares) <= 33
    # A value that holds most of the weight has a bin of its own, and what follows it has fine ones.
    crowded = large_forest.bin_edges(np.maximum(np.arange(1000.0), 900), one)
    assert crowded[:3].tolist() == [900.5, 901.5, 902.5] and len(crowded) == 31


def test_best_splits_of_counts_equal_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    counts, weights, least = rng.integers(0, 9, size=(5, 2, 4, 2)), (0.6, 3.0), 4
    counts[:, 1] = counts[:, 0, ::-1]
    halves = [counts // 2, counts - counts // 2]
    parts = spark.createDataFrame([(0, bytearray(h.astype("uint32").tobytes())) for h in halves], "tree int, counts binary")
    found = large_forest._splits(parts.repartition(2), {0: 2}, 4, weights, least, 2).first()
    table = np.frombuffer(bytes(found["splits"])).reshape(-1, 7)

    def gini(c):
        w = c * np.array(weights)
        return 1 - ((w / w.sum()) ** 2).sum(), w.sum()

    for node, (j, cut, gain, n0, n1, l0, l1) in zip(counts, table, strict=True):
        tried = {}
        for f in range(2):
            for c in range(3):
                left, right = node[f, : c + 1].sum(axis=0), node[f, c + 1 :].sum(axis=0)
                if min(left.sum(), right.sum()) >= least:
                    (p, w), (a, wa), (b, wb) = gini(left + right), gini(left), gini(right)
                    tried[f, c] = p - wa / w * a - wb / w * b
        assert gain == pytest.approx(max(tried.values())) and tried[int(j), int(cut)] == pytest.approx(gain)
        assert [n0, n1] == node[0].sum(axis=0).tolist()
        assert [l0, l1] == node[int(j), : int(cut) + 1].sum(axis=0).tolist()


def test_large_forest_keeps_the_rules_and_learns(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(classifiers, "REMEMBERED_PAIRS", 400 * 40 - 1)
    spread = rows.repartition(3, "TransactionID").persist()
    whole = Forest(trees=40, max_depth=6).fit(spread)
    # Several passes for a level find the same trees.
    monkeypatch.setattr(large_forest, "HELD_COUNTS", 2000)
    assert Forest(trees=40, max_depth=6).fit(spread).model.toDebugString.split("\n", 1)[1] == (
        whole.model.toDebugString.split("\n", 1)[1]
    )
    whole.save(str(tmp_path / "m"))
    data = rows.sparkSession.read.parquet(str(tmp_path / "m/data")).collect()
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in data}
    assert {t for t, _ in nodes} == set(range(40))
    depth = {}
    for (t, i), n in sorted(nodes.items()):
        here = depth.setdefault((t, i), 0)
        assert here <= 6 and n["rawCount"] >= 4
        if n["leftChild"] >= 0:
            a, b = nodes[t, n["leftChild"]], nodes[t, n["rightChild"]]
            depth[t, n["leftChild"]] = depth[t, n["rightChild"]] = here + 1
            assert a["rawCount"] + b["rawCount"] == n["rawCount"] and n["gain"] > 0
            both = [x + y for x, y in zip(a["impurityStats"], b["impurityStats"])]
            assert both == pytest.approx(n["impurityStats"])
            assert not (a["leftChild"] < 0 and b["leftChild"] < 0 and a["prediction"] == b["prediction"])
    # A bag has as many rows as the table, up to the draw; bags differ.
    bags = [nodes[t, 0]["rawCount"] for t in range(40)]
    assert abs(np.mean(bags) - 400) < 20 and len(set(bags)) > 10
    scored = whole.score(rows)
    assert ranking_metrics(scored, "isFraud", "p").first()["roc_auc"] > 0.9
    plain = RandomForestClassifier(numTrees=40, maxDepth=6, minInstancesPerNode=4, weightCol="weight", seed=42)
    weighted = with_weight(rows.selectExpr("*", "cast(isFraud as double) AS label"), "label", "balanced")
    other = Forest(model=plain.fit(weighted)).score(rows)
    both = scored.select("TransactionID", "p").join(other.selectExpr("TransactionID", "p AS q"), "TransactionID")
    assert both.selectExpr("corr(p, q)").first()[0] > 0.97
    with pytest.raises(ValueError):
        Forest(trees=40).fit(rows.withColumn("isFraud", rows["isFraud"] + 1))
