"""Speed of scoring, measured in the job that does the work."""

from __future__ import annotations

import time
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def speed_of(rows: int, seconds: float) -> dict[str, float]:
    return {
        "rows": float(rows),
        "rows_per_sec": rows / seconds if seconds else 0.0,
        "latency_b1_ms": 1000.0 * seconds / rows if rows else 0.0,
    }


def timed_write(df: DataFrame, write) -> dict[str, float]:
    """Speed of one job: ``write(df)`` runs it, and its rows are counted while it runs."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    started = time.perf_counter()
    write(counted)
    seconds = time.perf_counter() - started
    return speed_of(seen.get["rows"], seconds)


def scoring_speed(model, df: DataFrame) -> dict[str, float]:
    """Rows per second and milliseconds per row of scoring ``df`` into a discarding sink."""
    return timed_write(
        model.score(df).select("p"), lambda rows: rows.write.format("noop").mode("overwrite").save()
    )
