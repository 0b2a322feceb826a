"""Lookback windows of new rows from a stored table of each entity's last rows.

A new day or split is windowed without reading the rows before it: the state holds at most
``length - 1`` rows per entity, is joined to the new rows, and is then brought up to date.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.operators.skew import HOT_ROWS
from tallyguard.operators.windows import lookback_windows
from tallyguard.sources.versions import MissingVersion, open_version, publish


@dataclass(frozen=True)
class CarriedHistory:
    """Where the state lies, and what its rows are.

    ``features`` must contain whatever the windows shall show. Rows without entity have no
    history and are not carried.
    """

    spark: SparkSession
    path: str
    entity: str
    time: str
    tie: str
    features: tuple[str, ...]
    length: int = 10

    @property
    def _columns(self) -> list[str]:
        return list(dict.fromkeys([self.entity, self.time, self.tie, *self.features]))

    def rows(self) -> DataFrame | None:
        """The carried rows of the newest state, or None before the first batch."""
        try:
            return open_version(self.spark, self.path).parts["rows"]
        except MissingVersion:
            return None

    def windows(self, batch: DataFrame, min_history: int = 1, hot_rows: int = HOT_ROWS, name: str = "history") -> DataFrame:
        """``batch`` with its lookback windows, which reach back into the carried rows.

        The batch must not hold rows before carried ones; ``carry`` checks that.
        """
        carried = self.rows()
        rows = batch.withColumn("_carried", F.lit(False))
        if carried is not None:
            wanted = batch.select(self.entity).where(F.col(self.entity).isNotNull()).distinct()
            needed = carried.join(wanted, self.entity, "left_semi").withColumn("_carried", F.lit(True))
            rows = rows.unionByName(needed, allowMissingColumns=True)
        # The order is (time, id) over all batches, whatever split a row belongs to.
        split = {"split": "_split_name"} if "split" in batch.columns else {}
        found = lookback_windows(
            rows.withColumnsRenamed(split),
            self.entity,
            self.time,
            self.tie,
            [split.get(f, f) for f in self.features],
            self.length,
            min_history,
            hot_rows=hot_rows,
            name=name,
        )
        found = found.where(~F.col("_carried")).withColumnsRenamed({v: k for k, v in split.items()})
        if split and "split" in self.features:
            items = F.transform(name, lambda i: F.struct(*[i[split.get(f, f)].alias(f) for f in self.features]))
            found = found.withColumn(name, items)
        return found.select(*batch.columns, name)

    def carry(self, batch: DataFrame) -> None:
        """Merge ``batch`` into the state as a new version: the last rows of every entity.

        The rank limit is applied in each task before the shuffle, so an entity with very many
        rows sends at most ``length - 1`` of them per task. A batch that starts before the last
        carried row is an error, because windows already given out would have been others.
        """
        fresh = batch.where(F.col(self.entity).isNotNull()).select(*self._columns)
        key = F.struct(F.col(self.time).cast("double").alias("t"), F.col(self.tie).cast("double").alias("k"))
        first, last = fresh.where(F.col(self.time).isNotNull()).agg(F.min(key), F.max(key)).first()
        try:
            before = open_version(self.spark, self.path)
        except MissingVersion:
            before = None
        if before is not None:
            if first is not None and list(first) < before.note["last"]:
                raise ValueError(f"the batch starts at {tuple(first)}, before the carried {before.note['last']}")
            fresh = before.parts["rows"].unionByName(fresh)
        newest = Window.partitionBy(self.entity).orderBy(F.desc(self.time), F.desc(self.tie))
        kept = fresh.withColumn("_from_end", F.row_number().over(newest)).where(F.col("_from_end") < self.length)
        upto = list(last) if last is not None else before.note["last"] if before is not None else [float("-inf")] * 2
        publish(self.spark, self.path, {"rows": kept.drop("_from_end")}, {"last": upto})


def carried_windows(state: CarriedHistory, batches: Sequence[DataFrame]) -> list[DataFrame]:
    """Windows of successive batches, each written into the state before the next one."""
    found = []
    for number, batch in enumerate(batches):
        windowed = state.windows(batch)
        done = publish(state.spark, f"{state.path}-windows/{number}", {"rows": windowed})
        found.append(done.parts["rows"])
        state.carry(batch)
    return found
