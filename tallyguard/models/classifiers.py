"""Spark ML classifiers with one contract: fit(train[, dev]) then score(df).

``score`` keeps every row and column and adds ``p``, the probability of the positive class, and
``prediction``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.models.large_forest import grow_forest
from tallyguard.models.weights import with_weight
from tallyguard.operators.metrics import ranking_of_counts
from tallyguard.session import durable

INTERNAL = ("rawPrediction", "probability", "prediction")


def _labelled(df: DataFrame, features: str, y: str, *extra: str) -> DataFrame:
    return df.select(F.col(features).alias("features"), F.col(y).cast("double").alias("label"), *extra)


def _positive(model: Model, df: DataFrame, features: str) -> DataFrame:
    kept = df.columns
    scored = model.transform(df.withColumn("features", F.col(features)))
    return scored.select(
        *[c for c in kept if c not in ("p", *INTERNAL)],
        F.get(vector_to_array("probability"), 1).alias("p"),
        "prediction",
    )


# Training rows per partition: about 200 MB with a hundred features.
TRAINING_ROWS = 250_000


def spread_rows(df: DataFrame, row_id: str = "TransactionID") -> DataFrame:
    """Rows dealt evenly over the cluster by a unique id, before training passes over them.

    Iterative training repeats its pass many times, so one shuffle into as many partitions as
    the rows and the cores call for pays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TRAINING_ROWS)), row_id)


class NotFitted(RuntimeError):
    pass


def _without_summary(model: Model) -> Model:
    """The model without its training summary, which would send the training plan and the session
    along with every scoring task, and cannot be sent once the session has observed a query."""
    model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.apply(None))
    return model


@dataclass
class _Scorer:
    """Shared scoring and persistence; subclasses fit ``model``."""

    features: str = field(default="features", kw_only=True)
    target: str = field(default="isFraud", kw_only=True)
    seed: int = field(default=42, kw_only=True)
    model: Model | None = field(default=None, kw_only=True)
    loader = None

    def score(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("fit the model before scoring")
        return _positive(self.model, df, self.features)

    def settings(self) -> dict:
        """The parameters of the training, for the run log."""
        fitted = ("model", "pairs", "features", "target")
        return {k: v for k, v in vars(self).items() if k not in fitted}

    def save(self, path: str) -> None:
        if self.model is None:
            raise NotFitted("fit the model before saving")
        self.model.write().overwrite().save(path)

    def restore(self, path: str):
        self.model = type(self).loader.load(path)
        return self


@dataclass
class BoostedTrees(_Scorer):
    """Gradient-boosted trees; with dev rows the tree count with the best dev PR-AUC is kept."""

    max_depth: int = 6
    learning_rate: float = 0.05
    trees: int = 500
    subsample: float = 0.8
    feature_share: float = 0.8
    positive_weight: float | None = None
    patience: int = 30
    check_every: int = 10
    best_trees: int | None = None
    loader = GBTClassificationModel

    def _train(self, rows: DataFrame, trees: int) -> GBTClassificationModel:
        return GBTClassifier(
            maxDepth=self.max_depth,
            stepSize=self.learning_rate,
            maxIter=trees,
            subsamplingRate=self.subsample,
            featureSubsetStrategy=str(self.feature_share),
            weightCol="weight",
            seed=self.seed,
        ).fit(rows)

    def fit(self, train: DataFrame, dev: DataFrame | None = None) -> "BoostedTrees":
        rows = with_weight(
            _labelled(train, self.features, self.target), "label", "positive", self.positive_weight
        )
        model = self._train(rows, self.trees)
        self.best_trees = len(model.trees)
        if dev is not None:
            self.best_trees = _stop_early(self.dev_curve(model, dev), self.patience)
        self.model = first_trees(model, self.best_trees)
        return self

    def dev_curve(self, model: GBTClassificationModel, dev: DataFrame) -> list[tuple[int, float]]:
        """(number of trees, dev PR-AUC) at the checked tree counts, from one pass over ``dev``."""
        grown = len(model.trees)
        checked = sorted({*range(self.check_every, grown, self.check_every), grown})
        counts = durable(staged_counts(model, _labelled(dev, self.features, self.target), checked))
        areas = ranking_of_counts(counts, ["trees"]).select("trees", "pr_auc")
        return sorted((r["trees"], r["pr_auc"]) for r in areas.collect())  # one row per check


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The ensemble of the first ``count`` trees: boosting adds trees without changing earlier ones."""
    if count >= len(model.trees):
        return model
    context = SparkContext._active_spark_context
    gateway, java = context._gateway, model._java_obj
    trees = gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    shares = gateway.new_array(gateway.jvm.double, count)
    grown = java.trees()
    for i, share in enumerate(model.treeWeights[:count]):
        trees[i], shares[i] = grown[i], float(share)
    kind = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel
    cut = kind(java.uid(), trees, shares, model.numFeatures, model.numClasses)
    java.copyValues(cut, context._jvm.org.apache.spark.ml.param.ParamMap.empty())
    return GBTClassificationModel(cut)


def leaf_values(model: GBTClassificationModel) -> list[list[float]]:
    """Per tree the predictions of its leaves, from left to right, as the leaf numbers count."""
    trees: list[list[float]] = []
    for line in model.toDebugString.splitlines():
        words = line.split()
        if words[:1] == ["Tree"]:
            trees.append([])
        elif words[:1] == ["Predict:"]:
            trees[-1].append(float(words[1]))
    return trees


#: Distinct (tree count, score) pairs that a task holds before it passes its counts on.
HELD_SCORES = 1_000_000


def staged_counts(model: GBTClassificationModel, rows: DataFrame, checked: Sequence[int]) -> DataFrame:
    """(trees, p, pos, n): score counts of the ensemble cut after each of ``checked`` trees.

    The model names every row's leaf in every tree once; running sums over the leaf values are
    the margins of all cuts. A task folds its rows into counts per cut and score, so a row is
    never repeated per cut.
    """
    values = leaf_values(model)
    starts = np.cumsum([0, *[len(v) for v in values[:-1]]])
    flat = np.concatenate([np.asarray(v) * w for v, w in zip(values, model.treeWeights)])
    ends = np.asarray(checked) - 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in ends]

        def added(parts: list[tuple]) -> tuple:
            scores, at = np.unique(np.concatenate([s for s, _, _ in parts]), return_inverse=True)
            pos, n = (np.bincount(at, np.concatenate([x[i] for x in parts]), len(scores)) for i in (1, 2))
            return scores, pos, n

        def flush() -> pa.RecordBatch:
            sums = [added(parts) for parts in held]
            columns = [np.repeat(np.asarray(checked, "int32"), [len(s) for s, _, _ in sums])]
            columns += [np.concatenate([x[i] for x in sums]) for i in range(3)]
            kinds = ("int32", "float64", "int64", "int64")
            for parts in held:
                parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names=["trees", "p", "pos", "n"]
            )

        size = 0
        for batch in batches:
            if not len(batch):
                continue
            label = batch.column("label").to_numpy(zero_copy_only=False)
            leaves = batch.column("leaves").flatten().to_numpy(zero_copy_only=False)
            leaves = leaves.reshape(len(batch), len(values)).astype("int64")
            margins = np.cumsum(flat[leaves + starts], axis=1)[:, ends]
            one = np.ones(len(batch))
            for i, parts in enumerate(held):
                parts.append(added([(margins[:, i], (label == 1).astype("float64"), one)]))
                size += len(parts[-1][0])
            if size > HELD_SCORES:
                yield flush()
                size = 0
        if size:
            yield flush()

    leafy = model.copy()
    leafy.setLeafCol("_leaves")
    numbered = leafy.transform(rows).select("label", vector_to_array("_leaves").alias("leaves"))
    parts = numbered.mapInArrow(fold, "trees int, p double, pos long, n long")
    return parts.groupBy("trees", "p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def _stop_early(curve: Sequence[tuple[int, float]], patience: int) -> int:
    """Tree count of the best value before ``patience`` trees pass without a better one."""
    best_count, best = curve[0]
    for count, value in curve[1:]:
        if value > best:
            best_count, best = count, value
        elif count - best_count >= patience:
            break
    return best_count


#: (row, tree) pairs whose nodes the executors remember: about 20 bytes each with the copies kept.
#: Forests over more pairs are grown from binned rows.
REMEMBERED_PAIRS = 50_000_000


@dataclass
class Forest(_Scorer):
    """Random forest on balanced row weights."""

    trees: int = 300
    max_depth: int = 15
    min_leaf: int = 4
    loader = RandomForestClassificationModel

    def fit(self, train: DataFrame, dev: DataFrame | None = None) -> "Forest":
        rows = with_weight(_labelled(train, self.features, self.target), "label", "balanced")
        found = rows.groupBy("label").agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        labels = {r["label"]: r for r in found.collect()}  # one row per label
        total = sum(r["n"] for r in labels.values())
        if total * self.trees > REMEMBERED_PAIRS:
            if not set(labels) <= {0.0, 1.0}:
                raise ValueError(f"labels must be 0 or 1, got {sorted(labels, key=str)}")
            weights = tuple(labels[y]["weight"] if y in labels else 1.0 for y in (0.0, 1.0))
            self.model = grow_forest(rows, total, weights, self.trees, self.max_depth, self.min_leaf, self.seed)
            return self
        forest = RandomForestClassifier(
            numTrees=self.trees,
            maxDepth=self.max_depth,
            minInstancesPerNode=self.min_leaf,
            weightCol="weight",
            seed=self.seed,
            # The same trees: a row's node is remembered from level to level, not found from the root.
            cacheNodeIds=True,
            checkpointInterval=-1,
        )
        self.model = _without_summary(forest.fit(rows))
        return self


@dataclass
class CalibratedSvm(_Scorer):
    """Linear SVM with Platt calibration: three folds of the training rows, averaged."""

    alpha: float = 1e-4
    max_iter: int = 2000
    folds: int = 3
    row_id: str = "TransactionID"
    pairs: list[tuple[LinearSVCModel, LogisticRegressionModel]] = field(default_factory=list)

    def fit(self, train: DataFrame, dev: DataFrame | None = None) -> "CalibratedSvm":
        # The hash of the id spreads each class evenly over the folds at any size.
        fold = F.pmod(F.xxhash64(F.col(self.row_id), F.lit(self.seed)), F.lit(self.folds)).cast("int")
        rows = _labelled(train, self.features, self.target, fold.alias("fold")).persist()
        try:
            # A fold's fit is a row of short jobs that wait for one another; the folds do not.
            with ThreadPoolExecutor(self.folds) as pool:
                self.pairs = list(pool.map(lambda held: self._fit_fold(rows, held), range(self.folds)))
        finally:
            rows.unpersist()
        return self

    def _fit_fold(self, rows: DataFrame, held: int) -> tuple[LinearSVCModel, LogisticRegressionModel]:
        inner = with_weight(rows.where(F.col("fold") != held), "label", "balanced")
        machine = LinearSVC(
            regParam=self.alpha, maxIter=self.max_iter, standardization=False, weightCol="weight"
        )
        svm = _without_summary(machine.fit(inner))
        held_out = svm.transform(rows.where(F.col("fold") == held))
        platt = LogisticRegression(
            featuresCol="margin", labelCol="target", weightCol="share", regParam=0.0, standardization=False
        ).fit(_platt_rows(held_out))
        return svm, platt

    def score(self, df: DataFrame) -> DataFrame:
        if not self.pairs:
            raise NotFitted("fit the model before scoring")
        scored = df.withColumn("features", F.col(self.features))
        parts = []
        for i, (svm, platt) in enumerate(self.pairs):
            raw = f"_raw{i}"
            scored = svm.setRawPredictionCol(raw).setPredictionCol(f"_label{i}").transform(scored)
            z = F.lit(float(platt.intercept)) + F.lit(float(platt.coefficients[0])) * F.get(
                vector_to_array(raw), 1
            )
            parts.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
        kept = [c for c in df.columns if c not in ("p", "prediction")]
        return scored.select(*kept, mean.alias("p"), (mean > 0.5).cast("double").alias("prediction"))

    def save(self, path: str) -> None:
        if not self.pairs:
            raise NotFitted("fit the model before saving")
        for i, (svm, platt) in enumerate(self.pairs):
            svm.write().overwrite().save(f"{path}/svm_{i}")
            platt.write().overwrite().save(f"{path}/platt_{i}")

    def restore(self, path: str) -> "CalibratedSvm":
        self.pairs = [
            (LinearSVCModel.load(f"{path}/svm_{i}"), LogisticRegressionModel.load(f"{path}/platt_{i}"))
            for i in range(self.folds)
        ]
        return self


def _platt_rows(held_out: DataFrame) -> DataFrame:
    """Each row twice, as positive and negative, weighted by its smoothed target.

    The targets are (n+ + 1)/(n+ + 2) for positives and 1/(n- + 2) for negatives.
    """
    counts = held_out.agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    ).first()
    high, low = (counts["p"] + 1.0) / (counts["p"] + 2.0), 1.0 / (counts["n"] + 2.0)
    t = F.when(F.col("label") == 1, F.lit(high)).otherwise(F.lit(low))
    both = F.array(
        F.struct(F.lit(1.0).alias("target"), t.alias("share")),
        F.struct(F.lit(0.0).alias("target"), (1.0 - t).alias("share")),
    )
    margin = array_to_vector(F.array(F.get(vector_to_array("rawPrediction"), 1)))
    return held_out.select(margin.alias("margin"), F.inline(both))


def flat_window(window: str = "window", mask: str = "padding_mask") -> Column:
    """A padded window and its mask as one vector: all steps, then 1.0 per padded step."""
    padded = F.transform(F.col(mask), lambda m: m.cast("double"))
    return array_to_vector(F.concat(F.flatten(window), padded))


@dataclass
class SequenceNetwork(_Scorer):
    """Feed-forward network on the flattened lookback window."""

    hidden: tuple[int, ...] = (32,)
    max_iter: int = 100
    loader = MultilayerPerceptronClassificationModel

    def fit(self, train: DataFrame, dev: DataFrame | None = None) -> "SequenceNetwork":
        rows = _labelled(train, self.features, self.target)
        width = len(rows.first()["features"])
        network = MultilayerPerceptronClassifier(
            layers=[width, *self.hidden, 2], maxIter=self.max_iter, seed=self.seed
        )
        self.model = _without_summary(network.fit(rows))
        return self
