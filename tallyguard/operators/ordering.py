"""Exact order statistics, global row numbers and running totals without a global sort.

A window without ``partitionBy`` moves every row to one task. The functions here first find
range edges from approximate quantiles. The edges only balance the work; counts and positions
are exact whatever the edges are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.sketches import LARGEST, SMALLEST, quantiles, rank_error, size_for, sketched
from tallyguard.session import partition_target

GATHER_ROWS = 20_000
#: Items of all sketches that a task holds together.
SKETCH_ITEMS = 1 << 20


@dataclass(frozen=True)
class Rank:
    """The value at a rank, with the number of values below it and equal to it.

    ``carried`` is the carried value of the row at the rank, where it was read off directly.
    """

    value: object
    below: int
    equal: int
    carried: object = None


@dataclass
class _Range:
    """An open value range known to hold the wanted rank, with exact counts around it."""

    column: str
    rank: int
    low: object
    high: object
    below: int
    inside: int

    def holds(self) -> Column:
        col = F.col(self.column)
        keep = col.isNotNull()
        if self.low is not None:
            keep = keep & (col > F.lit(self.low))
        if self.high is not None:
            keep = keep & (col < F.lit(self.high))
        return keep


def _scan(df: DataFrame, expressions: list[Column]) -> list:
    """One aggregate over the data; returns the values in order."""
    named = [e.alias(f"a{i}") for i, e in enumerate(expressions)]
    return list(df.agg(*named).first())


def _held(df: DataFrame, ranges: list[_Range]) -> DataFrame:
    """Rows that some open range holds; the bounds reach the file scan, which skips the rest."""
    return df.where(reduce(or_, [r.holds() for r in ranges]))


def sketch_size(columns: int) -> int:
    """The largest sketch for a few columns, smaller ones where a task holds many."""
    return max(SMALLEST, min(LARGEST, SKETCH_ITEMS // max(columns, 1)))


def shares_around(share: float, k: int) -> list[float]:
    """Two shares that enclose the given one, up to the error of a sketch of size ``k``."""
    margin = 2.0 * rank_error(k)
    return [max(0.0, share - margin), min(1.0, share + margin)]


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    totals: Mapping[str, int] | None = None,
    carry: str | None = None,
    guesses: Mapping[tuple[str, int], Sequence] | None = None,
    gather_rows: int = GATHER_ROWS,
    places: bool = True,
) -> dict[str, dict[int, Rank]]:
    """Exact values at zero-based ascending ``ranks`` among the non-null values of each column.

    Each round narrows every open range with a quantile sketch and then counts exactly, so no
    row is shuffled or sorted. A range with at most ``gather_rows`` values is finished directly.
    One round cuts a range to less than a thousandth of its rows, for few columns.

    ``totals`` and ``guesses`` (two enclosing values per rank) save the first count and sketch.
    Rows with equal values are ranked by ``carry``. Without ``places`` only values are wanted.
    """
    found: dict[str, dict[int, Rank]] = {column: {} for column in ranks}
    if totals is None:
        totals = dict(zip(ranks, _scan(df, [F.count(F.col(c)) for c in ranks])))
    open_ranges = []
    for column, wanted in ranks.items():
        for rank in dict.fromkeys(wanted):
            if not 0 <= rank < totals[column]:
                raise IndexError(f"rank {rank} outside the {totals[column]} values of {column}")
            open_ranges.append(_Range(column, rank, None, None, 0, totals[column]))

    while open_ranges:
        _finish(df, [r for r in open_ranges if r.inside <= gather_rows], carry, places, found)
        open_ranges = _narrow(df, [r for r in open_ranges if r.inside > gather_rows], guesses, found)
        guesses = None
    return found


def _finish(
    df: DataFrame, ranges: list[_Range], carry: str | None, places: bool, found: dict
) -> None:
    """Read the rank off the sorted values of a small range."""
    if not ranges:
        return
    carried = F.col(carry) if carry else F.lit(None).cast("int")
    # Neighbouring ranks usually share a range, which is gathered once.
    lists = {(r.column, r.low, r.high): r for r in ranges}
    slots = {key: f"s{i}" for i, key in enumerate(lists)}
    gathered = _held(df, ranges).agg(
        *[
            F.sort_array(
                F.collect_list(
                    F.when(r.holds(), F.struct(F.col(r.column).alias("v"), carried.alias("c")))
                )
            ).alias(slots[key])
            for key, r in lists.items()
        ]
    )
    where = [slots[(r.column, r.low, r.high)] for r in ranges]
    at = gathered.select(
        "*",
        *[F.element_at(s, r.rank - r.below + 1).alias(f"at{i}") for i, (r, s) in enumerate(zip(ranges, where))],
    )
    picked = at.select(
        *[
            F.struct(
                F.col(f"at{i}.v").alias("value"),
                (_matching(s, f"at{i}", below=True) if places else F.lit(0)).alias("below"),
                (_matching(s, f"at{i}", below=False) if places else F.lit(0)).alias("equal"),
                F.col(f"at{i}.c").alias("carried"),
            )
            for i, s in enumerate(where)
        ]
    ).first()
    for r, p in zip(ranges, picked):
        found[r.column][r.rank] = Rank(p["value"], r.below + p["below"], p["equal"], p["carried"])


def _matching(pairs: str, at: str, below: bool) -> Column:
    wanted = F.col(f"{at}.v")
    return F.size(F.filter(pairs, lambda p: p["v"] < wanted if below else p["v"] == wanted))


def _narrow(
    df: DataFrame, ranges: list[_Range], guesses: Mapping | None, found: dict
) -> list[_Range]:
    if not ranges:
        return []
    if guesses:
        edges = [guesses[(r.column, r.rank)] for r in ranges]
    else:
        edges = _around(df, ranges)
    # Neighbouring ranks usually share range and edges, which are counted once.
    marks = {(r.column, r.low, r.high, e): r for r, pair in zip(ranges, edges) for e in pair}
    counts = [
        F.count_if(r.holds() & test)
        for (column, _, _, e), r in marks.items()
        for test in (F.col(column) < F.lit(e), F.col(column) <= F.lit(e))
    ]
    counted = _scan(_held(df, ranges), counts)
    around = {
        mark: (r.below + counted[2 * i], r.below + counted[2 * i + 1]) for i, (mark, r) in enumerate(marks.items())
    }
    still_open = []
    for r, (lo, hi) in zip(ranges, edges):
        below_lo, through_lo = around[(r.column, r.low, r.high, lo)]
        below_hi, through_hi = around[(r.column, r.low, r.high, hi)]
        if r.rank < below_lo:
            still_open.append(_Range(r.column, r.rank, r.low, lo, r.below, below_lo - r.below))
        elif r.rank < through_lo:
            found[r.column][r.rank] = Rank(lo, below_lo, through_lo - below_lo)
        elif r.rank < below_hi:
            between = below_hi - through_lo
            still_open.append(_Range(r.column, r.rank, lo, hi, through_lo, between))
        elif r.rank < through_hi:
            found[r.column][r.rank] = Rank(hi, below_hi, through_hi - below_hi)
        else:
            above = r.below + r.inside - through_hi
            still_open.append(_Range(r.column, r.rank, hi, r.high, through_hi, above))
    return still_open


def _around(df: DataFrame, ranges: list[_Range]) -> list[list]:
    """Two values around the rank of each range, from one sketch per distinct range."""
    lists = {(r.column, r.low, r.high): r for r in ranges}
    names = {key: f"r{i}" for i, key in enumerate(lists)}
    k = sketch_size(len(lists))
    values = {names[key]: F.when(r.holds(), F.col(r.column)) for key, r in lists.items()}
    wanted: dict[str, list[float]] = {name: [] for name in values}
    for r in ranges:
        wanted[names[r.column, r.low, r.high]] += shares_around((r.rank - r.below) / r.inside, k)
    found, _ = quantiles(_held(df, ranges), values, wanted, k=k)
    at = {name: iter(points) for name, points in found.items()}
    return [[next(at[names[r.column, r.low, r.high]]) for _ in range(2)] for r in ranges]


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Median (mean of the middle two) of the non-null values per column; None if all null."""
    columns = list(columns)
    if not columns:
        return {}
    k = sketch_size(len(columns))
    points, totals = quantiles(
        df,
        {f"v{i}": F.col(c) for i, c in enumerate(columns)},
        {f"v{i}": shares_around(0.5, k) for i in range(len(columns))},
        {f"n{i}": F.count(F.col(c)) for i, c in enumerate(columns)},
        k,
    )
    counts = {c: totals[f"n{i}"] for i, c in enumerate(columns)}
    around = {c: points[f"v{i}"] for i, c in enumerate(columns)}
    ranks = {c: [(n - 1) // 2, n // 2] for c, n in counts.items() if n}
    guesses = {(c, k): around[c] for c, ks in ranks.items() for k in ks}
    values = order_statistics(df, ranks, counts, guesses=guesses, places=False) if ranks else {}
    medians: dict[str, float | None] = {}
    for c in columns:
        if c in values:
            lower, upper = (float(values[c][k].value) for k in ranks[c])
            medians[c] = lower if lower == upper else (lower + upper) / 2.0
        else:
            medians[c] = None
    return medians


def quantile_edges(df: DataFrame, column: str, pieces: int | None = None) -> list[float]:
    """Distinct inner edges that cut ``column`` into about ``pieces`` equal shares.

    Without ``pieces`` the rows, counted in the same pass, decide. A value that is the quantile
    of several shares gets a range of its own, which ends just above it, so that neighbours do
    not share the range of a hot value.
    """
    if pieces is not None and pieces < 2:
        return []
    value = {"v": F.col(column).cast("double")}
    if pieces is not None:
        return _edges(quantiles(df, value, {"v": _cuts(pieces)}, k=size_for(pieces))[0]["v"])
    found = sketched(df, value, {"n": F.count(F.lit(1))})
    return _edges(found.at({"v": _cuts(partition_target(df.sparkSession, found.totals["n"]))})["v"])


def _cuts(pieces: int) -> list[float]:
    return [i / pieces for i in range(1, pieces)]


def _edges(points: list) -> list[float]:
    points = [float(x) for x in points]
    hot = {a for a, b in zip(points, points[1:]) if a == b}
    above = {math.nextafter(v, math.inf) for v in hot} - {math.inf}
    return sorted({*points, *above})


def with_bucket(df: DataFrame, column: str, edges: Sequence[float], name: str) -> DataFrame:
    """Number of the range a value falls in; monotone in ``column``. NaN gets a bucket behind
    all values, null one behind that."""
    null = F.lit(len(edges) + 2)
    if not edges:
        return df.withColumn(name, F.when(F.col(column).isNull(), null).otherwise(F.lit(0)))
    splits = [float("-inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep")
    return cut.transform(df).withColumn(name, F.coalesce(F.col(name).cast("int"), null))


@dataclass(frozen=True)
class KeyRanges:
    """Ranges of (time, tie) that hold about equal shares of the rows they were measured on.

    A single time value that fills more than two shares is cut again on ``tie``. Range numbers
    ascend with (time, tie), null times last, and are dense from 0.
    """

    time: str
    tie: str
    edges: list[float]
    heavy: list[int]
    tie_edges: list[float]

    @property
    def count(self) -> int:
        return (len(self.edges) + 3) + len(self.heavy) * (len(self.tie_edges) + 2)

    def numbered(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the number of the range of each row: a projection, whatever the size."""
        ranged = with_bucket(df, self.time, self.edges, name)
        if not self.heavy:
            return ranged
        inside = f"{name}_tie"
        ranged = with_bucket(ranged, self.tie, self.tie_edges, inside)
        # Each heavy range before a row's own one takes as many numbers as it has cuts more.
        more = len(self.tie_edges) + 2
        shift = sum((F.when(F.col(name) > h, more).otherwise(0) for h in self.heavy), F.lit(0))
        own = F.when(F.col(name).isin(self.heavy), F.col(inside)).otherwise(0)
        return ranged.withColumn(name, (F.col(name) + shift + own).cast("int")).drop(inside)


def key_ranges(df: DataFrame, time: str, tie: str, pieces: int | None = None) -> KeyRanges:
    """Measure ranges on ``df``, which only has to have the keys: one pass, and one more to see
    whether single time values are crowded."""
    keys = df.select(time, tie)
    value, counts = {"v": F.col(time).cast("double")}, {"n": F.count(F.lit(1)), "timed": F.count(F.col(time))}
    if pieces is None:
        found = sketched(keys, value, counts)
        totals, pieces = found.totals, partition_target(df.sparkSession, found.totals["n"])
        edges = _edges(found.at({"v": _cuts(pieces)})["v"])
    else:
        points, totals = quantiles(keys, value, {"v": _cuts(pieces)}, counts, size_for(pieces))
        edges = _edges(points["v"])
    n, untimed = totals["n"], totals["n"] - totals["timed"]
    # Only a value that took two shares or more of the sketch can fill more than two shares.
    crowded = [e for e, up in zip(edges, edges[1:]) if up == math.nextafter(e, math.inf)]
    heavy, tie_edges = [], []
    if crowded or untimed * pieces > 2 * n:
        ranged = with_bucket(keys, time, edges, "_range")
        heavy = _single_value_ranges(ranged, time, pieces)
        if heavy:
            tie_edges = quantile_edges(ranged.where(F.col("_range").isin(heavy)), tie, pieces)
    return KeyRanges(time, tie, edges, sorted(heavy), tie_edges)


def global_row_number(
    df: DataFrame, time: str, tie: str, name: str = "row_number", pieces: int | None = None
) -> DataFrame:
    """Exact position of each row (from 1) in (time, tie) order over the whole table.

    Rows with a null time come last, in the order of ``tie``. Rows are cut into ranges of
    (time, tie). One shuffle on the range number, a local sort, and an offset per range.
    """
    ranged = key_ranges(df, time, tie, pieces).numbered(df, "_range")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range, so this unpartitioned window is small by construction.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_range").orderBy(F.col(time).asc_nulls_last(), tie)
    placed = ranged.withColumn("_at", F.row_number().over(inside))
    return (
        placed.join(offsets, "_range")
        .withColumn(name, (F.col("_off") + F.col("_at")).cast("long"))
        .drop("_range", "_off", "_at")
    )


def _single_value_ranges(ranged: DataFrame, time: str, pieces: int) -> list[int]:
    """Ranges that hold one single time value and more than two shares of the rows."""
    shape = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi")
    )
    rows = shape.collect()  # one row per range
    total = sum(r["n"] for r in rows)
    return [r["_range"] for r in rows if r["lo"] == r["hi"] and r["n"] * pieces > 2 * total]


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    edges: Sequence[float] = (),
) -> DataFrame:
    """Adds ``cum_<v>`` (inclusive running sum in ``order``) and ``all_<v>`` (group total).

    ``(by, order)`` must be unique. ``edges`` cut ``order`` into ranges, so no window partition
    holds a whole group; the per-range totals that link them are small. Without edges a group
    is one window partition, for callers that know it is short.
    """
    by = list(by)
    if not edges:
        group = Window.partitionBy(*by)
        column = F.col(order).desc() if descending else F.col(order).asc()
        running = group.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.sum(v).over(running).alias(f"cum_{v}") for v in values],
            *[F.sum(v).over(group).alias(f"all_{v}") for v in values],
        )
    # One key per (group, range): a struct compares null groups as equal, and the window and
    # the join below share one shuffle on it.
    ranged = with_bucket(df, order, list(edges), "_range").withColumn(
        "_cell", F.struct(*by, "_range")
    )

    def arranged(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    sums = ranged.groupBy("_cell").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    group = Window.partitionBy(*[F.col(f"_cell.{c}") for c in by])
    before = group.orderBy(arranged("_cell._range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_cell",
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(group).alias(f"all_{v}") for v in values],
    )
    inside = (
        Window.partitionBy("_cell")
        .orderBy(arranged(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    return local.join(offsets, "_cell").select(
        *df.columns,
        *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"cum_{v}") for v in values],
        *[F.col(f"all_{v}") for v in values],
    )
