"""Exact top-k search by inner product, with branch and bound over dimension blocks.

Candidates and queries are packed into blocks of bounded size, each one row. A block holds its
vectors dimension by dimension (vertical layout), strongest dimension first, and the length of
what remains of each vector after every dimension block. Each pair of a query block and a
candidate block is one row of an equi-join on both numbers; there scores are summed over one
dimension block at a time, and candidates whose sum plus the largest possible rest stays below
the k-th best sum minus its largest possible loss are dropped before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.common import written

#: Vectors in a block, and dimensions summed before the bounds are looked at again.
CANDIDATES = 4096
QUERIES = 256
STEP = 16
#: Sums below this are exact in doubles.
EXACT = 2.0**52


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if any is null or not finite.

    Components so large that an inner product might not fit a long are an error.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    wide = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    whole = F.transform(wide, lambda x: F.floor(x * scale).cast("long"))
    largest = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(v), F.lit(1))))
    wild = F.exists(wide, lambda x: F.abs(x * scale) > largest)
    checked = F.when(wild, F.raise_error(F.lit("vector components too large for whole-number scores")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), checked.otherwise(whole))


def _vertical(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = block["id"].to_numpy(np.int64)
    return ids, np.stack(block["v"].to_numpy()).astype(np.int64).T.copy()


def pack_blocks(vectors: DataFrame) -> DataFrame:
    """Rows (dim, block, id, v) as one row per (dim, block) with ids and a vertical matrix."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = _vertical(rows)
        return pd.DataFrame(
            {
                "dim": [rows["dim"].iloc[0]],
                "block": [rows["block"].iloc[0]],
                "ids": [ids.tobytes()],
                "data": [matrix.tobytes()],
            }
        )

    return vectors.groupBy("dim", "block").applyInPandas(
        pack, "dim int, block int, ids binary, data binary"
    )


def best_of_block(
    queries: np.ndarray, matrix: np.ndarray, k: int, step: int = STEP
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (a row), the places and scores of every candidate (a column) that may be
    among the block's ``k`` best, equal scores included."""
    dim, n = matrix.shape
    order = np.argsort(-(matrix.astype(np.float64) ** 2).sum(1), kind="stable")
    most = np.abs(matrix).max(initial=0) * float(np.abs(queries).max(initial=0)) * max(dim, 1)
    kind = np.float64 if most < EXACT else np.int64
    rows, points = matrix[order].astype(kind), queries[:, order].astype(kind)
    cuts = list(range(0, dim, step)) + [dim]

    def rests(m: np.ndarray) -> list[np.ndarray]:
        squares = m.astype(np.float64) ** 2
        # A little more than the true length, so that rounding never drops a candidate.
        return [np.sqrt(squares[c:].sum(0)) * (1 + 1e-9) for c in cuts[1:]]

    rest, query_rest = rests(rows), rests(points.T)
    first = points[:, : cuts[1]] @ rows[: cuts[1]] if dim else np.zeros((len(queries), n), kind)
    found = []
    for q in range(len(queries)):
        alive, score = None, first[q]
        for b in range(1, len(cuts)):
            if b > 1:
                low, high = cuts[b - 1], cuts[b]
                part = rows[low:high] if alive is None else rows[low:high, alive]
                score = score + points[q, low:high] @ part
            if len(score) > k:
                swing = query_rest[b - 1][q] * (rest[b - 1] if alive is None else rest[b - 1][alive])
                sure = score - swing
                bar = np.partition(sure, len(sure) - k)[len(sure) - k]
                keep = np.flatnonzero(score + swing >= bar - 1e-6 * abs(bar))
                alive = keep if alive is None else alive[keep]
                score = score[keep]
        alive = np.arange(n) if alive is None else alive
        found.append((alive, score.astype(np.int64)))
    return found


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """Each query row's ``k`` highest inner products: query_id, rank, vec_id, score.

    Components are floor(scale * x). Ties go to the smaller id; a query with fewer candidates
    gets all. Rows with a null key, a null vector, or a null or non-finite component take no
    part, and vectors meet only vectors of their length. Rows that repeat key and vector count
    once, and a query never meets rows of its own key. Scores that might not fit a long are an
    error. An empty table
    gives an empty table. Other columns of ``df`` are not read.
    """
    rows = (
        df.select(F.col(f"`{key}`").cast("long").alias("id"), quantised(vector, scale).alias("v"), is_query.alias("q"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .dropDuplicates(["id", "v"])
        .withColumn("dim", F.size("v"))
    )
    rows = written(rows)
    # How many vectors of each length there are; one row per length.
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / candidates).cast("int").alias("n_c"),
        F.ceil(F.count(F.when(F.col("q"), 1)) / queries).cast("int").alias("n_q"),
    )
    dealt = rows.join(sizes, "dim")
    number = lambda n: F.pmod(F.xxhash64("id", "v"), F.greatest(n, F.lit(1))).cast("int")
    c_rows = dealt.withColumn("block", number(F.col("n_c")))
    q_rows = dealt.where("q").withColumn("block", number(F.col("n_q")))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    c_blocks = pack_blocks(c_rows.select("dim", "block", "id", "v")).join(sizes, "dim")
    q_blocks = pack_blocks(q_rows.select("dim", "block", "id", "v")).join(sizes, "dim")
    c_side = c_blocks.where("n_q > 0").select(
        "dim", F.col("block").alias("c"), every(F.col("n_q")).alias("qb"),
        F.col("ids").alias("c_ids"), F.col("data").alias("c_data"),
    )
    q_side = q_blocks.select(
        "dim", F.col("block").alias("qb"), every(F.col("n_c")).alias("c"),
        F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
    )
    pairs = q_side.join(c_side, ["dim", "qb", "c"]).select("dim", "q_ids", "q_data", "c_ids", "c_data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *parts in zip(*(column.to_pylist() for column in batch.columns)):
                q_ids, q_data, c_ids, c_data = (np.frombuffer(p, np.int64) for p in parts)
                points = q_data.reshape(dim, len(q_ids)).T
                matrix = c_data.reshape(dim, len(c_ids))
                out = []
                # The query itself and ids that repeat may stand among the best.
                own = int(np.unique(c_ids, return_counts=True)[1].max())
                for q, (at, score) in zip(q_ids, best_of_block(points, matrix, (k + 1) * own)):
                    other = c_ids[at] != q
                    hits = np.unique(np.stack([-score[other], c_ids[at][other]], 1), axis=0)[:k]
                    out.append((np.full(len(hits), q), hits[:, 1], -hits[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", key, "score"]
                )

    found = pairs.mapInArrow(search, f"query_id long, `{key}` long, score long")
    # Spark keeps the first k of each query in every task before the shuffle.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(f"`{key}`"))
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "rank"]).select(
        "query_id", F.col("rank").cast("int").alias("rank"), f"`{key}`", "score"
    )
