"""Synthetic transactions with rare fraud, for trials without data.

Every value is a function of (row number, seed, column), so the table does not depend on how
Spark partitions it and a lost task regenerates the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shapes of the generated distributions and the value pools.
FIRST_ID = 3_000_000
FIRST_SECOND = 86_400
LAST_SECOND = 86_400 * 180
CARD3_POOL = (150, 185, 144, 106)
CARD4_POOL = ("visa", "mastercard", "discover", "american express")
CARD6_POOL = {"debit": 0.75, "credit": 0.25}
PRODUCT_POOL = {"W": 0.74, "C": 0.12, "R": 0.07, "H": 0.05, "S": 0.02}
ADDR2_POOL = (87, 60, 96)
DEVICE_TYPE_POOL = {"desktop": 0.55, "mobile": 0.45}
DEVICE_POOL = ("iOS Device", "Windows", "MacOS", "SM-G950F", "Trident/7.0")
IDENTITY_SHARE = 0.25


class _Draws:
    """Uniform and derived draws for one key column."""

    def __init__(self, key: str, seed: int):
        self.key, self.seed = key, seed

    def uniform(self, name: str, *more: Column) -> Column:
        """In (0, 1): 52 hash bits, offset by half a step."""
        bits = F.pmod(F.xxhash64(F.col(self.key), F.lit(self.seed), F.lit(name), *more), F.lit(2**52))
        return (bits.cast("double") + 0.5) / float(2**52)

    def integer(self, name: str, low: int, high: int) -> Column:
        """From low up to but not including high."""
        return (F.floor(self.uniform(name) * (high - low)) + low).cast("int")

    def normal(self, name: str) -> Column:
        radius = F.sqrt(-2.0 * F.log(self.uniform(name + "/r")))
        return radius * F.cos(2.0 * math.pi * self.uniform(name + "/a"))

    def exponential(self, name: str, mean: float) -> Column:
        return -F.log(self.uniform(name)) * mean

    def pick(self, name: str, pool: Sequence) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in pool]), self.integer(name, 1, len(pool) + 1))

    def weighted(self, name: str, pool: dict[str, float]) -> Column:
        u, below, chosen = self.uniform(name), 0.0, None
        values = list(pool)
        for value in values[:-1]:
            below += pool[value]
            hit = u < below
            chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
        return chosen.otherwise(values[-1])

    def poisson(self, name: str, rate: float, longest: int = 25) -> Column:
        """Number of distribution-function steps below a uniform draw.

        The tail beyond ``longest`` is negligible for small rates.
        """
        term, total, steps = math.exp(-rate), 0.0, []
        for k in range(longest):
            total += term
            steps.append(F.lit(total))
            term *= rate / (k + 1)
        draw = self.uniform(name)
        return F.size(F.filter(F.array(*steps), lambda s: s < draw))

    def beta(self, name: str, a: float, b: float, tries: int = 12) -> Column:
        """Johnk's method: the first of several pairs with x + y <= 1 gives x / (x + y)."""
        pairs = F.transform(
            F.sequence(F.lit(1), F.lit(tries)),
            lambda i: F.struct(
                F.pow(self.uniform(name + "/x", i), F.lit(1.0 / a)).alias("x"),
                F.pow(self.uniform(name + "/y", i), F.lit(1.0 / b)).alias("y"),
            ),
        )
        first = F.get(F.filter(pairs, lambda s: s["x"] + s["y"] <= 1.0), 0)
        return F.coalesce(first["x"] / (first["x"] + first["y"]), F.lit(a / (a + b)))


def synthetic_tables(
    spark: SparkSession, rows: int = 50_000, entities: int = 2_500, fraud_rate: float = 0.035, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(transactions, identity). Identity covers about a quarter of the transactions."""
    e = _Draws("entity", seed)
    t = _Draws("row", seed)
    span = LAST_SECOND - FIRST_SECOND
    # One draw per equal slice of the span: sorted by construction, no global sort.
    moment = FIRST_SECOND + (F.col("row") + t.uniform("time")) * (span / rows)
    base = spark.range(rows).select(F.col("id").alias("row")).withColumn(
        "entity", F.floor(t.uniform("entity") * entities).cast("long")
    )
    # Entity attributes are functions of the entity number, so no entity table is joined.
    fraud = t.uniform("fraud") < e.beta("propensity", 0.3, 8.0) * 0.4 + fraud_rate * 0.3
    labelled = base.withColumn("isFraud", fraud.cast("int"))
    amount = F.exp(t.normal("amount") * 1.2 + 3.8)
    raised = amount * (1.5 + 2.5 * t.uniform("raise"))
    transactions = labelled.select(
        (F.col("row") + FIRST_ID).alias("TransactionID"),
        "isFraud",
        F.floor(moment).cast("long").alias("TransactionDT"),
        F.round(F.when(F.col("isFraud") == 1, raised).otherwise(amount), 2).alias("TransactionAmt"),
        t.weighted("ProductCD", PRODUCT_POOL).alias("ProductCD"),
        e.integer("card1", 1000, 19999).alias("card1"),
        e.integer("card2", 100, 600).cast("float").alias("card2"),
        e.pick("card3", CARD3_POOL).cast("float").alias("card3"),
        e.pick("card4", CARD4_POOL).alias("card4"),
        t.weighted("card6", CARD6_POOL).alias("card6"),
        e.integer("addr1", 100, 500).cast("float").alias("addr1"),
        t.pick("addr2", ADDR2_POOL).cast("float").alias("addr2"),
        t.exponential("dist1", 15.0).cast("float").alias("dist1"),
        e.integer("D1", 0, 600).cast("float").alias("D1"),
        t.integer("D2", 0, 500).cast("float").alias("D2"),
        t.integer("D15", 0, 600).cast("float").alias("D15"),
        *[t.poisson(f"C{i}", 1.5).cast("float").alias(f"C{i}") for i in range(1, 15)],
        *[t.normal(f"V{i}").cast("float").alias(f"V{i}") for i in range(1, 41)],
    )
    identity = (
        base.where(t.uniform("identity") < IDENTITY_SHARE)
        .select(
            (F.col("row") + FIRST_ID).alias("TransactionID"),
            (t.uniform("id_01") * 100.0 - 100.0).cast("float").alias("id_01"),
            t.integer("id_02", 1000, 900000).cast("float").alias("id_02"),
            t.weighted("DeviceType", DEVICE_TYPE_POOL).alias("DeviceType"),
            t.pick("DeviceInfo", DEVICE_POOL).alias("DeviceInfo"),
            *[t.normal(f"id_{i:02d}").cast("float").alias(f"id_{i:02d}") for i in range(3, 12)],
        )
    )
    return transactions, identity
