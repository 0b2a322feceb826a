"""Random search over the boosted-tree settings, scored by dev PR-AUC."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from tallyguard.models.classifiers import BoostedTrees
from tallyguard.operators.metrics import ranking_metrics

# The search space (low, high); the learning rate is drawn on a log scale.
MAX_DEPTH = (4, 10)
LEARNING_RATE = (0.01, 0.2)
SUBSAMPLE = (0.6, 1.0)
POSITIVE_WEIGHT = (10.0, 35.0)


def draw_settings(trials: int, seed: int = 42) -> list[dict]:
    """Seeded draws; the same seed gives the same trials."""
    rng = random.Random(seed)
    low, high = (math.log(v) for v in LEARNING_RATE)
    return [
        {
            "max_depth": rng.randint(*MAX_DEPTH),
            "learning_rate": math.exp(rng.uniform(low, high)),
            "subsample": rng.uniform(*SUBSAMPLE),
            "positive_weight": rng.uniform(*POSITIVE_WEIGHT),
        }
        for _ in range(trials)
    ]


def search_boosted_trees(
    train: DataFrame,
    dev: DataFrame,
    trials: int = 20,
    trees: int = 300,
    patience: int = 20,
    check_every: int = 10,
    parallelism: int = 2,
    features: str = "features",
    target: str = "isFraud",
    seed: int = 42,
) -> list[dict]:
    """Trial settings with ``pr_auc``, best first. A one-class dev part scores 0.

    Trials run as concurrent Spark jobs on the same cached rows.
    """
    train, dev = train.select(features, target).persist(), dev.select(features, target).persist()

    def run(settings: dict) -> dict:
        model = BoostedTrees(
            **settings,
            trees=trees,
            patience=patience,
            check_every=check_every,
            features=features,
            target=target,
            seed=seed,
        ).fit(train, dev)
        area = ranking_metrics(model.score(dev), target, "p").first()["pr_auc"]
        return {**settings, "trees": model.best_trees, "pr_auc": area}

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            results = list(pool.map(run, draw_settings(trials, seed)))
    finally:
        train.unpersist()
        dev.unpersist()
    return sorted(results, key=lambda r: -r["pr_auc"])
