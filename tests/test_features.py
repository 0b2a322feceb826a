"""Expressions, fitted features, correlation and latent features."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyguard.functions.expressions import entity_key, with_cyclical
from tallyguard.operators import latent
from tallyguard.operators.correlation import correlation_matrix, redundant_columns
from tallyguard.operators.preprocess import (
    fit_features,
    load_features,
    save_features,
    transform_features,
)

PARTS = ["card1", "card2", "card3", "card4", "addr1", "D1"]


def test_entity_key_text(spark):
    df = spark.createDataFrame(
        [(None,) * 6, (73, 0.5, -2.0, "", 41.25, 6.0), (-5, None, 8.5, "x_y", None, 0.0)],
        "card1 int, card2 double, card3 double, card4 string, addr1 double, D1 double",
    )
    keys = [r[0] for r in df.select(entity_key(df, PARTS)).collect()]
    assert keys == ["0_0.0_0.0_UNK_0.0_0.0", "73_0.5_-2.0__41.25_6.0", "-5_0.0_8.5_x_y_0.0_0.0"]


def test_entity_key_has_no_exponents(spark):
    numbers = [1e7, 12345678.5, 1e-4, 1e-13, 2e-13, 1.23456789e-7, -4.5e-9, 1e15, 123456789012345680000.0, 9.5e20, -1e16, 0.1, 5e-324, 1.7976931348623157e308]
    df = spark.createDataFrame([(x,) for x in numbers], "a double")
    found = [r[0] for r in df.select(entity_key(df, ["a"])).collect()]
    assert not any("E" in text for text in found) and len(set(found)) == len(numbers)
    assert [float(text) for text in found] == numbers
    assert found[:5] == ["10000000.0", "12345678.5", "0.0001", "0.0000000000001", "0.0000000000002"]
    assert found[7:9] == ["1000000000000000.0", "123456789012345680000.0"]
    single = spark.createDataFrame([(float("nan"),), (1e-5,), (3e9,)], "a float")
    assert [r[0] for r in single.select(entity_key(single, ["a"])).collect()] == ["NaN", "0.00001", "3000000000.0"]


def test_cyclical_range(spark):
    df = with_cyclical(spark.range(0, 10**6, 997).withColumnRenamed("id", "t"), "t")
    names = ["hour_sin", "hour_cos", "day_sin", "day_cos"]
    low, high = df.select(F.least(*names).alias("l"), F.greatest(*names).alias("h")).agg(F.min("l"), F.max("h")).first()
    assert -1.0 <= low and high <= 1.0
    negative = with_cyclical(spark.createDataFrame([(-3600,)], "t long"), "t").first()
    assert negative["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 23 / 24))


def sample(spark):
    """Rows every 50 minutes; ``copy`` follows ``level`` up to a small wobble."""
    rows = []
    for i in range(170):
        level = float((i * 29) % 83)
        shop = ["kiosk", None, "web", "web"][i % 4]
        rows.append((i, i * 3000, f"e{i % 11}", i % 9 == 0, shop, level, 5 - 2 * level + i % 2, None, i % 5 < 2))
    schema = "TransactionID long, TransactionDT long, card_id string, isFraud boolean, shop string, level double, copy double, hollow double, flag boolean"
    return spark.createDataFrame(rows, schema).withColumn("isFraud", F.col("isFraud").cast("int"))


def test_fit_on_train_only(spark):
    train = sample(spark)
    state = fit_features(train, correlation_threshold=0.95)
    assert state.all_null == ["hollow"]
    assert "level" in state.numeric and "copy" not in state.numeric
    assert state.numeric[-4:] == ["hour_sin", "hour_cos", "day_sin", "day_cos"]
    assert state.feature_names[-1] == "cat_shop" and "num_flag" in state.feature_names
    later = train.limit(10).withColumn("shop", F.lit("by post")).withColumn("level", F.lit(None).cast("double"))
    found = transform_features(later, state).collect()
    assert {r["cat_shop"] for r in found} == {0.0}
    median = (state.medians["level"] - state.means["level"]) / state.scales["level"]
    assert all(r["num_level"] == pytest.approx(median) for r in found)
    known = transform_features(train, state)
    stats = known.agg(F.avg("num_level"), F.stddev_pop("num_level"), F.min("cat_shop")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and stats[2] > 0
    # MISSING, kiosk, web in sorted order: upper case first.
    codes = known.join(train.select("TransactionID", "shop"), "TransactionID").select("shop", "cat_shop").distinct()
    assert {r["shop"]: r["cat_shop"] for r in codes.collect()} == {None: 0.25, "kiosk": 0.5, "web": 0.75}


def test_nan_counts_as_missing(spark):
    rows = [(i, i, "a", 0, float("nan") if i < 3 else float(i)) for i in range(9)]
    train = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, card_id string, isFraud int, v double")
    state = fit_features(train)
    assert state.medians["v"] == 5.5


def test_large_dictionary_equals_inline_codes(spark, tmp_path):
    rows = [(i, i, "e", 0, f"k{(i * 37) % 301}") for i in range(900)]
    train = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, card_id string, isFraud int, c string")
    later = train.unionByName(train.limit(3).withColumn("c", F.lit("zz")))
    inline = fit_features(train, inline_categories=1000)
    joined = fit_features(train, inline_categories=20)
    assert joined.category_counts == inline.category_counts == {"c": 301}
    one = sorted(r["cat_c"] for r in transform_features(later, inline).collect())
    assert one == sorted(r["cat_c"] for r in transform_features(later, joined).collect())
    save_features(joined, spark, str(tmp_path / "state"))
    again = load_features(spark, str(tmp_path / "state"))
    assert again.feature_names == joined.feature_names
    assert one == sorted(r["cat_c"] for r in transform_features(later, again).collect())


def test_missing_metadata_is_null(spark):
    train = sample(spark).drop("hollow")
    state = fit_features(train)
    found = transform_features(train.drop("card_id", "isFraud"), state).first()
    assert found["card_id"] is None and found["isFraud"] is None


def test_correlation_equals_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    x[:, 3] = x[:, 0] * 2 + 1e6
    x[:, 4] = 3.0
    x[rng.random((400, 5)) < 0.2] = np.nan
    names = [f"c{i}" for i in range(5)]
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    import pandas as pd

    expected = pd.DataFrame(x, columns=names).corr()
    for r in correlation_matrix(df, names).collect():
        if "c4" in (r["col_i"], r["col_j"]):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(expected.loc[r["col_i"], r["col_j"]], abs=1e-9)
    assert redundant_columns(df, names, 0.9) == ["c3"]


def test_dropped_column_still_drops_later_ones(spark):
    rows = [(float(i), float(i + i % 3), float(i + 2 * (i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert redundant_columns(df, ["a", "b", "c"], 0.9) == ["b", "c"]


def vectors(spark, n=300, d=20, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(3, 0.5, d)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, v array<double>")


def test_pca_equals_eigenvectors(spark):
    x, df = vectors(spark)
    fitted = latent.fit_pca(latent.as_vector(df, "v"))
    values, loadings = np.linalg.eigh(np.cov(x.T))
    ratios = values[::-1] / values.sum()
    assert fitted.ratios == pytest.approx(ratios)
    assert all(a >= b - 1e-12 for a, b in zip(fitted.ratios, fitted.ratios[1:]))
    k = int(np.argmax(np.cumsum(ratios) >= 0.9)) + 1
    assert fitted.k == max(3, k)
    rows = latent.with_projection(latent.as_vector(df, "v"), fitted).orderBy("id").collect()
    found = np.array([r["latent"] for r in rows])
    expected = (x - x.mean(axis=0)) @ loadings[:, ::-1][:, : fitted.k]
    assert np.abs(found) == pytest.approx(np.abs(expected), abs=1e-6)
    assert found.mean(axis=0) == pytest.approx(np.zeros(fitted.k), abs=1e-9)


def test_wanted_components_win(spark):
    _, df = vectors(spark, 100)
    fitted = latent.fit_pca(latent.as_vector(df, "v"), threshold=0.99999, n_components=5)
    assert fitted.k == 5 and len(fitted.ratios) == 5


def test_component_choice():
    assert latent.choose_components([0.95, 0.03, 0.02], 10, 3, 0.9, None) == 3
    assert latent.choose_components([0.95, 0.05], 10, 2, 0.9, None) == 2
    assert latent.choose_components([0.4, 0.3, 0.2, 0.1], 10, 4, 0.8, None) == 3


def test_projection_and_centroids_survive_saving(spark, tmp_path):
    _, df = vectors(spark)
    fitted = latent.fit_pca(latent.as_vector(df, "v"))
    fitted.save(spark, str(tmp_path / "pca"))
    again = latent.Projection.load(spark, str(tmp_path / "pca"))
    assert again.k == fitted.k and again.components == pytest.approx(fitted.components)
    centroids = latent.fit_kmeans(df, "v", 4)
    latent.save_centroids(spark, centroids, str(tmp_path / "centroids"))
    assert latent.load_centroids(spark, str(tmp_path / "centroids")) == centroids


def test_distances_and_augmentation(spark):
    x, df = vectors(spark, 100)
    centroids = latent.fit_kmeans(df, "v", 4)
    assert len(centroids) == 4 and centroids == sorted(centroids)
    rows = latent.as_vector(df, "v").withColumn("d", latent.centroid_distances(F.col("v"), centroids))
    wide = latent.augment(rows, "features", "d").withColumn("near", latent.nearest("d")).orderBy("id").collect()
    expected = np.linalg.norm(x[:, None, :] - np.array(centroids)[None], axis=2)
    assert np.array([r["d"] for r in wide]) == pytest.approx(expected)
    assert [r["near"] for r in wide] == expected.argmin(axis=1).tolist()
    assert all(len(r["features_augmented"]) == 24 for r in wide)


def test_first_nearest_wins(spark):
    df = spark.createDataFrame([([2.0, 1.0, 1.0],)], "d array<double>")
    assert df.select(latent.nearest("d")).first()[0] == 1
