"""Out-of-time train/dev/test split by exact global rank of time."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyguard.operators.ordering import order_statistics, shares_around, sketch_size
from tallyguard.operators.sketches import quantiles

SPLITS = ("train", "dev", "test")


@dataclass(frozen=True)
class SplitBoundaries:
    """First (time, id) key of dev and of test; None where that part is empty."""

    dev_start: tuple | None
    test_start: tuple | None
    rows: int
    train_rows: int
    dev_rows: int


def split_sizes(n: int, train: float, dev: float, test: float) -> tuple[int, int]:
    """Rows in train and dev. Truncates; a tiny table still gets non-empty dev and test."""
    if not math.isclose(train + dev + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"ratios must sum to 1, got {train + dev + test}")
    n_train, n_dev = int(n * train), int(n * dev)
    if n_dev == 0 and n >= 10:
        n_dev = max(1, int(n * 0.1))
        n_train = n - 2 * n_dev
    return n_train, n_dev


def split_boundaries(
    df: DataFrame,
    time: str,
    tie: str,
    train: float = 0.8,
    dev: float = 0.1,
    test: float = 0.1,
) -> SplitBoundaries:
    """Find the two cut keys by exact selection, so no row is sorted or shuffled.

    ``tie`` must be a numeric unique id; rows are ranked by (time, tie).
    """
    keys = df.select(F.col(time).alias("t"), F.col(tie).alias("k"))
    # One pass counts the rows and sketches where the cuts will be.
    k = sketch_size(1)
    around = [x for share in (train, train + dev) for x in shares_around(min(max(share, 0.0), 1.0), k)]
    points, totals = quantiles(
        keys,
        {"t": F.col("t")},
        {"t": around},
        {"n": F.count(F.lit(1)), "missing": F.count_if(F.col("t").isNull() | F.col("k").isNull())},
        k,
    )
    n, missing = totals["n"], totals["missing"]
    if missing:
        raise ValueError(f"{missing} rows have no {time} or no {tie}")
    n_train, n_dev = split_sizes(n, train, dev, test)
    cuts = [r for r in dict.fromkeys([n_train, n_train + n_dev]) if r < n]
    guesses = {("t", n_train + n_dev): points["t"][2:], ("t", n_train): points["t"][:2]} if n else {}
    starts = _keys_at(keys, cuts, n, guesses) if cuts else {}
    return SplitBoundaries(
        starts.get(n_train), starts.get(n_train + n_dev), n, n_train, n_dev
    )


def _keys_at(keys: DataFrame, ranks: list[int], n: int, guesses: dict) -> dict[int, tuple]:
    """(time, tie) at each zero-based rank: select the time, then the tie inside that time."""
    times = order_statistics(keys, {"t": ranks}, {"t": n}, carry="k", guesses=guesses)["t"]
    found = {r: (times[r].value, times[r].carried) for r in ranks}
    tied = {r: f"k{i}" for i, r in enumerate(ranks) if times[r].carried is None}
    if tied:
        # A cut inside a crowded time: select the tie among the rows of that time.
        same_time = keys.where(F.col("t").isin([times[r].value for r in tied])).select(
            *[F.when(F.col("t") == F.lit(times[r].value), F.col("k")).alias(c) for r, c in tied.items()]
        )
        inner = {r: r - times[r].below for r in tied}
        ties = order_statistics(
            same_time,
            {c: [inner[r]] for r, c in tied.items()},
            {c: times[r].equal for r, c in tied.items()},
        )
        for r, c in tied.items():
            found[r] = (times[r].value, ties[c][inner[r]].value)
    return found


def _before(time: str, tie: str, key: tuple | None) -> Column:
    if key is None:
        return F.lit(True)
    t, k = key
    return (F.col(time) < F.lit(t)) | ((F.col(time) == F.lit(t)) & (F.col(tie) < F.lit(k)))


def assign_split(df: DataFrame, bounds: SplitBoundaries, time: str, tie: str) -> DataFrame:
    """Adds ``split``. A projection with two literal keys: no shuffle at any size."""
    part = F.when(_before(time, tie, bounds.dev_start), F.lit("train")).when(
        _before(time, tie, bounds.test_start), F.lit("dev")
    )
    return df.withColumn("split", part.otherwise(F.lit("test")))


def only_split(df: DataFrame, bounds: SplitBoundaries, split: str, time: str, tie: str) -> DataFrame:
    """The rows of one split, read with a plain range on ``time`` that reaches the file scan."""
    start = {"train": None, "dev": bounds.dev_start, "test": bounds.test_start}[split]
    end = {"train": bounds.dev_start, "dev": bounds.test_start, "test": None}[split]
    if split != "train" and start is None:
        return df.where(F.lit(False))
    rows = df
    if start is not None:
        rows = rows.where(F.col(time) >= F.lit(start[0])).where(~_before(time, tie, start))
    if end is not None:
        rows = rows.where(F.col(time) <= F.lit(end[0])).where(_before(time, tie, end))
    return rows.withColumn("split", F.lit(split))


def temporal_split(
    df: DataFrame,
    time: str = "TransactionDT",
    tie: str = "TransactionID",
    train: float = 0.8,
    dev: float = 0.1,
    test: float = 0.1,
) -> DataFrame:
    return assign_split(df, split_boundaries(df, time, tie, train, dev, test), time, tie)


def split_order() -> Column:
    return (
        F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    )


def split_audit(df: DataFrame, time: str, label: str) -> DataFrame:
    """Rows, positives, positive rate and time range of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(label).cast("long")).alias("n_pos"),
        F.avg(F.col(label).cast("double")).alias("pos_rate"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
    )


def check_no_lookahead(audit: DataFrame) -> None:
    """Fail when a split ends after the next one starts. Reads the three audit rows."""
    check_order({row["split"]: row for row in audit.collect()})


def check_order(seen: Mapping[str, Mapping]) -> None:
    """Fail when a split's ``max_time`` is past the next one's ``min_time``."""
    present = [seen[s] for s in SPLITS if s in seen]
    for earlier, later in zip(present, present[1:]):
        if earlier["max_time"] > later["min_time"]:
            raise ValueError(f"{earlier['split']} reaches past the start of {later['split']}")


def audited(df: DataFrame, time: str, label: str) -> tuple[DataFrame, Callable[[], dict[str, dict]]]:
    """``df`` with counters that fill while it is written, and a function that reads them after.

    The audit of ``split_audit`` then costs no pass of its own. Splits without rows are left out.
    """
    seen = Observation()
    y = F.col(label).cast("long")
    measures = {
        "n_rows": lambda part: F.count_if(part),
        "n_pos": lambda part: F.sum(F.when(part, y)),
        "labelled": lambda part: F.count(F.when(part, y)),
        "min_time": lambda part: F.min(F.when(part, F.col(time))),
        "max_time": lambda part: F.max(F.when(part, F.col(time))),
    }
    columns = [f(F.col("split") == s).alias(f"{s}_{m}") for s in SPLITS for m, f in measures.items()]

    def read() -> dict[str, dict]:
        got = seen.get
        parts = {s: {"split": s} | {m: got[f"{s}_{m}"] for m in measures} for s in SPLITS}
        for part in parts.values():
            labelled = part.pop("labelled")
            part["pos_rate"] = part["n_pos"] / labelled if labelled else None
        return {s: p for s, p in parts.items() if p["n_rows"]}

    return df.observe(seen, *columns), read
