"""Tables behind the leaderboard, latency and latent-space reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.expressions import lookup

# Leaderboard columns, the metric each one shows, and its default.
LEADERBOARD = {
    "PR-AUC": ("pr_auc", 0.0),
    "ROC-AUC": ("roc_auc", 0.0),
    "F1 (Fraud)": ("fraud_f1", 0.0),
    "F1 (Fraud @ 0.5)": ("fraud_f1_50", 0.0),
    "Optimal Threshold": ("optimal_threshold", 0.5),
    "Recall @ 95% Prec": ("recall_at_95_precision", 0.0),
    "Brier Score": ("brier_score", 0.0),
    "Training Time (s)": ("train_duration_sec", 0.0),
    "Latency (ms/sample)": ("latency_b1_ms", 0.0),
    "Model Size (MB)": ("checkpoint_mb", 1.5),
}

# Model families, service tiers by latency in milliseconds, and shown texts.
FAMILIES = {
    "XGBoost": "Tree",
    "BoostedTrees": "Tree",
    "RandomForest": "Tree",
    "CalibratedSVM": "Linear",
    "BiLSTM": "Recurrent",
    "Transformer": "Attention",
}
DEFAULT_FAMILY = "Neural"
BATCH_LATENCY_SHARE = 0.15
CARD_LIMIT_MS = 2.0
TIER_CARD = "In-Flight Card Auth"  # below 2
TIER_NEAR = "Near-Line Risk Check"  # 2 to 10
TIER_BATCH = "Post-Auth AML Batch"  # above 50
TIER_NONE = "unassigned"
CALIBRATION_AXIS = "Calibration (1-Brier)"
LABEL_TEXT = {1: "Fraud (1)", 0: "Legitimate (0)"}
CLUSTER_TEXT = "Cluster "
LATENT_ROWS = 2000


def leaderboard(runs: DataFrame) -> DataFrame:
    """One row per run with the ten leaderboard columns; absent metrics get their default."""
    shown = [
        F.coalesce(F.col("metrics")[metric], F.lit(default)).alias(title)
        for title, (metric, default) in LEADERBOARD.items()
    ]
    return runs.select(F.col("model").alias("Model"), *shown)


def best_models(board: DataFrame) -> DataFrame:
    """Winner per headline metric; the first model name wins a tie."""
    wanted = [("PR-AUC", True), ("ROC-AUC", True), ("F1 (Fraud)", True), ("Latency (ms/sample)", False)]
    picks = []
    for title, highest in wanted:
        value = F.col(f"`{title}`")
        key = F.struct((-value if highest else value).alias("rank"), F.col("Model").alias("m"), value.alias("v"))
        picks.append(F.min(key).alias(title))
    one_row = board.agg(*picks)
    rows = F.array(
        *[
            F.struct(
                F.lit(title).alias("metric"),
                F.col(f"`{title}`")["m"].alias("model"),
                F.col(f"`{title}`")["v"].alias("value"),
            )
            for title, _ in wanted
        ]
    )
    return one_row.select(F.inline(rows))


def competency_profile(board: DataFrame) -> DataFrame:
    """Five axes per model in long form; calibration is 1 - 10 x Brier, not below 0."""
    calibration = F.greatest(F.lit(0.0), 1.0 - F.col("`Brier Score`") * 10)
    axes = {t: F.col(f"`{t}`") for t in ("PR-AUC", "ROC-AUC", "F1 (Fraud)", "Recall @ 95% Prec")}
    axes[CALIBRATION_AXIS] = calibration
    rows = F.array(*[F.struct(F.lit(t).alias("axis"), c.alias("value")) for t, c in axes.items()])
    return board.select("Model", F.inline(rows))


def latency_table(board: DataFrame) -> DataFrame:
    """Family, single and batch latency, size, accuracy, and whether the card limit is met."""
    single = F.col("`Latency (ms/sample)`")
    measured = "Latency B64 (ms/sample)"
    batch = single * BATCH_LATENCY_SHARE
    if measured in board.columns:
        batch = F.coalesce(F.col(f"`{measured}`"), batch)
    return board.select(
        "Model",
        lookup("Model", FAMILIES, DEFAULT_FAMILY).alias("Architecture"),
        F.col("`PR-AUC`"),
        single.alias("Latency (ms/sample)"),
        batch.alias(measured),
        F.col("`Model Size (MB)`"),
        (single < CARD_LIMIT_MS).alias("within_card_limit"),
    )


def service_tier(latency: str):
    """Tier by latency; 10 to 50 ms belongs to none."""
    ms = F.col(latency)
    return (
        F.when(ms < CARD_LIMIT_MS, TIER_CARD)
        .when(ms <= 10, TIER_NEAR)
        .when(ms > 50, TIER_BATCH)
        .otherwise(TIER_NONE)
    )


def latent_points(df: DataFrame, coordinates: str, label: str, cluster: str, row_id: str) -> DataFrame:
    """First three coordinates with readable label and cluster."""
    axes = [F.get(F.col(coordinates), i).alias(f"PCA_{i + 1}") for i in range(3)]
    return df.select(
        row_id,
        *axes,
        F.when(F.col(label) == 1, LABEL_TEXT[1]).otherwise(LABEL_TEXT[0]).alias("isFraud"),
        F.concat(F.lit(CLUSTER_TEXT), F.col(cluster).cast("string")).alias("Cluster"),
    )


def first_rows(df: DataFrame, time: str, tie: str, n: int = LATENT_ROWS) -> DataFrame:
    """The first ``n`` rows in time order (a top-n, not a full sort)."""
    return df.orderBy(time, tie).limit(n)


def cluster_profile(points: DataFrame) -> DataFrame:
    return points.groupBy("Cluster", "isFraud").agg(F.count(F.lit(1)).alias("n"))
