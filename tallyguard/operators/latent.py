"""Principal components and cluster distances as features."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Fixed value: the share of the variance that the kept components explain.
VARIANCE_TARGET = 0.90


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Scalar columns as one ML vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def as_vector(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


@dataclass
class Projection:
    """Fitted components (one column per component), feature means and variance ratios."""

    mean: np.ndarray
    components: np.ndarray
    ratios: np.ndarray
    k: int

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (i, self.components[:, i].tolist(), float(self.ratios[i]), self.k, self.mean.tolist())
            for i in range(self.components.shape[1])
        ]
        schema = "component int, loadings array<double>, ratio double, k int, mean array<double>"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Projection":
        rows = spark.read.parquet(path).orderBy("component").collect()  # one row per component
        loadings = np.array([r["loadings"] for r in rows]).T
        return cls(
            np.array(rows[0]["mean"]), loadings, np.array([r["ratio"] for r in rows]), rows[0]["k"]
        )


def choose_components(
    ratios: Sequence[float], rows: int, width: int, threshold: float, wanted: int | None
) -> int:
    """Fewest components that reach the variance threshold, at least 3, at most min(n, d)."""
    most = min(rows, width)
    if wanted is not None:
        return min(wanted, most)
    reached = np.flatnonzero(np.cumsum(ratios) >= threshold)
    k = int(reached[0]) + 1 if len(reached) else most
    return min(max(3, k), most)


def fit_pca(
    df: DataFrame, features: str = "features", threshold: float = VARIANCE_TARGET, n_components: int | None = None
) -> Projection:
    """Fit on an ML vector column. Only the d x d result reaches the driver.

    The sign of each component is fixed: its largest loading in absolute value is positive.
    """
    row = df.agg(Summarizer.mean(F.col(features)), F.count(F.lit(1))).first()
    mean, n = np.array(row[0].toArray()), row[1]
    width = len(mean)
    evaluated = min(n, width) if n_components is None else min(n, width, n_components)
    model = PCA(k=evaluated, inputCol=features).fit(df.select(features))
    components = np.array(model.pc.toArray())
    largest = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    components = components * np.where(largest < 0, -1.0, 1.0)
    ratios = np.array(model.explainedVariance.toArray())
    return Projection(mean, components, ratios, choose_components(ratios, n, width, threshold, n_components))


def _jvm_model(spark: SparkSession, projection: Projection) -> PCAModel:
    """Spark's own model of the first k components, built from the stored loadings."""
    context, k = spark.sparkContext, projection.k
    loadings = projection.components[:, :k]
    matrix = DenseMatrix(*loadings.shape, loadings.ravel(order="F").tolist())
    java = context._jvm.org.apache.spark.ml.feature.PCAModel(
        f"pca_{uuid.uuid4().hex[:12]}",
        _py2java(context, matrix),
        _py2java(context, Vectors.dense(projection.ratios[:k].tolist())),
    )
    return PCAModel(java)._set(k=k)


def with_projection(
    df: DataFrame, projection: Projection, features: str = "features", name: str = "latent"
) -> DataFrame:
    """Adds (x - mean) times the first k components, as an array, without a Python worker.

    Multiplying is left to Spark's model, whose loadings have the fixed signs; the projected
    mean is the same for all rows and is subtracted behind it.
    """
    raw = f"_{name}_raw"
    centre = projection.mean @ projection.components[:, : projection.k]
    model = _jvm_model(df.sparkSession, projection).setInputCol(features).setOutputCol(raw)
    shifted = F.zip_with(vector_to_array(raw), F.array(*[F.lit(float(c)) for c in centre]), lambda a, c: a - c)
    return model.transform(df).withColumn(name, shifted).drop(raw)


def scree_table(spark: SparkSession, projection: Projection, target: float = VARIANCE_TARGET) -> DataFrame:
    """Variance ratio per component, its running sum, and whether that is within ``target``."""
    rows = [(i + 1, float(r)) for i, r in enumerate(projection.ratios)]
    running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spark.createDataFrame(rows, "component int, variance_ratio double")
        .withColumn("cumulative_ratio", F.sum("variance_ratio").over(running))
        .withColumn("within_target", F.col("cumulative_ratio") <= F.lit(float(target)))
    )


def fit_kmeans(df: DataFrame, array: str = "latent", k: int = 8, seed: int = 42, max_iter: int = 20) -> list[list[float]]:
    """Centroids of k-means over an array column, sorted so that the numbering is stable."""
    vectors = df.select(array_to_vector(F.col(array).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||").fit(vectors)
    return sorted(c.tolist() for c in model.clusterCenters())


def label_centroids(df: DataFrame, array: str, label: str) -> DataFrame:
    """Mean vector per label: one vector per task and label is shuffled, whatever its length."""
    vector = array_to_vector(F.col(array).cast("array<double>"))
    means = df.where(F.col(array).isNotNull()).groupBy(label).agg(Summarizer.mean(vector).alias("centroid"))
    return means.withColumn("centroid", vector_to_array("centroid"))


def centroid_distances(values: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """Euclidean distance to each centroid, for an array<double> column.

    The centroids are K x d model state, so they travel with the task.
    """
    centres = np.asarray(centroids, dtype="float64")

    @F.arrow_udf("array<double>")
    def apply(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), centres.shape[1])
        # One centroid at a time keeps the working set at rows x d.
        y = np.column_stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres])
        ends = pa.array(np.arange(len(batch) + 1) * len(centres), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(y.ravel()))

    return apply(values)


def nearest(distances: str) -> Column:
    """Zero-based number of the closest centroid; the first wins a tie."""
    return F.array_position(distances, F.array_min(distances)) - 1


def augment(df: DataFrame, features: str, distances: str, name: str = "features_augmented") -> DataFrame:
    """Feature vector followed by the distances. Rows never separate, so nothing is joined."""
    both = F.concat(vector_to_array(features), F.col(distances).cast("array<double>"))
    return df.withColumn(name, array_to_vector(both))


def save_centroids(spark: SparkSession, centroids: Sequence[Sequence[float]], path: str) -> None:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cluster int, centroid array<double>").write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> list[list[float]]:
    return [list(r["centroid"]) for r in spark.read.parquet(path).orderBy("cluster").collect()]
