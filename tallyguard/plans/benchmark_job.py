"""The whole benchmark as a job of stages that can be started again.

Every stage publishes its tables under the run's folder, manifest last. A job that is started
again with the same run id opens what is finished and goes on with the first stage that is not;
half-written files of a broken attempt are never read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.models.benchmark import timed_write
from tallyguard.models.classifiers import spread_rows
from tallyguard.operators import latent
from tallyguard.operators.metrics import best_threshold, metrics_record
from tallyguard.operators.preprocess import fit_features, load_features, save_features, transform_features
from tallyguard.operators.split import SPLITS, audited, check_order, temporal_split
from tallyguard.reports import tables
from tallyguard.sources import files, runlog
from tallyguard.sources.versions import MissingVersion, Version, open_version, publish, stored_bytes

MEGABYTE = 1 << 20


@dataclass(frozen=True)
class Stages:
    """The stages of one run under ``folder``."""

    spark: SparkSession
    folder: str
    run_id: str

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.run_id}"

    def opened(self, name: str) -> Version | None:
        try:
            return open_version(self.spark, f"{self.path}/{name}")
        except MissingVersion:
            return None

    def stage(
        self, name: str, build: Callable[[], tuple[Mapping[str, DataFrame], Mapping]], partition_by: Mapping | None = None
    ) -> Version:
        """What the stage published, now or in an earlier attempt."""
        done = self.opened(name)
        if done is None:
            parts, note = build()
            done = publish(self.spark, f"{self.path}/{name}", parts, note, partition_by)
        return done


@dataclass
class Benchmark:
    """The outputs of a finished run."""

    splits: DataFrame
    points: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    runs: DataFrame
    models: dict[str, dict]
    scree: DataFrame
    clusters: int

    def leaderboard(self) -> DataFrame:
        return tables.leaderboard(self.runs)

    def latent_points(self, row_id: str = "TransactionID", target: str = "isFraud") -> DataFrame:
        return tables.latent_points(self.points, "latent", target, "cluster", row_id)


def run_benchmark(
    rows: DataFrame,
    folder: str,
    run_id: str,
    models: Mapping[str, object],
    time_column: str = "TransactionDT",
    row_id: str = "TransactionID",
    target: str = "isFraud",
    entity: str = "card_id",
    clusters: int = 8,
    variance: float = latent.VARIANCE_TARGET,
    before_stage: Callable[[str], None] = lambda name: None,
) -> Benchmark:
    """Split, features, latent space, models, predictions, metrics and run log of ``rows``.

    ``before_stage`` is called with the name of every stage that is about to run.
    """
    spark = rows.sparkSession
    stages = Stages(spark, folder, run_id)

    def stage(name: str, build, partition_by=None) -> Version:
        def begun():
            before_stage(name)
            return build()

        return stages.stage(name, begun, partition_by)

    def split():
        found, audit = audited(temporal_split(rows, time_column, row_id), time_column, target)
        path = f"{stages.path}/rows/{uuid.uuid4().hex}"
        files.write_parquet(found, path, ["split"])
        facts = audit()
        check_order(facts)
        return {}, {"path": path, "audit": facts}

    def placed(name: str) -> DataFrame:
        """The rows of one split of a stage that is partitioned by split: one folder is read."""
        return spread_rows(matrix.where(F.col("split") == name), row_id)

    splits = spark.read.parquet(stage("splits", split).note["path"])

    def features():
        train = splits.where(F.col("split") == "train").drop("split")
        state = fit_features(train, target, time_column, entity, row_id)
        return {}, {"state": save_features(state, spark, f"{stages.path}/state"), "names": state.feature_names}

    fitted = stage("features", features).note

    def space():
        state = load_features(spark, f"{stages.path}/state", fitted["state"])
        train = latent.assemble(
            transform_features(splits.where(F.col("split") == "train"), state), fitted["names"]
        )
        projection = latent.fit_pca(train, threshold=variance)
        near = latent.with_projection(train, projection)
        centroids = latent.fit_kmeans(near, "latent", clusters)
        path = f"{stages.path}/space/{uuid.uuid4().hex}"
        projection.save(spark, f"{path}/projection")
        latent.save_centroids(spark, centroids, f"{path}/centroids")
        return {}, {"path": path, "clusters": len(centroids)}

    fitted_space = stage("latent_space", space).note
    projection = latent.Projection.load(spark, f"{fitted_space['path']}/projection")
    centroids = latent.load_centroids(spark, f"{fitted_space['path']}/centroids")

    def points():
        state = load_features(spark, f"{stages.path}/state", fitted["state"])
        every = latent.assemble(transform_features(splits, state), fitted["names"])
        near = latent.with_projection(every, projection)
        near = near.withColumn("distances", latent.centroid_distances(F.col("latent"), centroids))
        near = near.withColumn("cluster", latent.nearest("distances").cast("int"))
        wide = latent.augment(near, "features", "distances")
        kept = wide.select(
            row_id, target, "split", "latent", "distances", "cluster", F.col("features_augmented").alias("features")
        )
        return {"points": kept}, {}

    matrix = stage("points", points, {"points": ["split"]}).parts["points"]

    trained, scored, records = {}, [], []
    for name, model in models.items():
        trained[name], predictions, record = _model_stages(stage, stages, name, model, placed, row_id, target)
        scored.append(predictions)
        records.append(record)

    metrics = _stacked(records)
    log = f"{folder}/run_log"

    def logged():
        params = {name: facts["settings"] for name, facts in trained.items()}
        runlog.append_runs(runlog.run_rows(metrics, params=params, run_id=run_id), log, batch=run_id)
        return {}, {}

    stage("run_log", logged)
    runs = runlog.read_runs(spark, log).where(F.col("run_id").endswith(run_id))
    return Benchmark(
        splits,
        matrix,
        _stacked(scored),
        metrics,
        runs,
        trained,
        latent.scree_table(spark, projection, variance),
        fitted_space["clusters"],
    )


def _model_stages(stage, stages: Stages, name: str, model, placed, row_id: str, target: str) -> tuple:
    """Train and store one model, then score test while it is timed, then measure."""
    spark = stages.spark

    def train():
        started = time.perf_counter()
        model.fit(placed("train"), placed("dev"))
        seconds = time.perf_counter() - started
        path = f"{stages.path}/stored/{name}-{uuid.uuid4().hex}"
        model.save(path)
        cut = best_threshold(model.score(placed("dev")), target, "p").first()["threshold"]
        facts = {"path": path, "seconds": seconds, "threshold": cut, "settings": model.settings()}
        return {}, facts | {"megabytes": stored_bytes(spark, path) / MEGABYTE}

    facts = stage(f"model_{name}", train).note

    def predict():
        scored = model.restore(facts["path"]).score(placed(SPLITS[-1])).select(row_id, target, "p", "prediction")
        path = f"{stages.path}/scores/{name}-{uuid.uuid4().hex}"
        speed = timed_write(scored, lambda counted: files.write_parquet(counted, path))
        return {}, {"path": path, "speed": speed}

    done = stage(f"predictions_{name}", predict).note
    predictions = spark.read.parquet(done["path"]).select(F.lit(name).alias("model"), "*")

    def measure():
        record = metrics_record(predictions, target, "p", optimal_threshold=facts["threshold"])
        measured = {
            "train_duration_sec": facts["seconds"],
            "latency_b1_ms": done["speed"]["latency_b1_ms"],
            "rows_per_sec": done["speed"]["rows_per_sec"],
            "checkpoint_mb": facts["megabytes"],
        }
        columns = [F.lit(float(v)).alias(k) for k, v in measured.items()]
        return {"record": record.select(F.lit(name).alias("model"), "*", *columns)}, {}

    return facts, predictions, stage(f"metrics_{name}", measure).parts["record"]


def _stacked(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole
