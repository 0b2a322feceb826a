"""Sequence packing by minimum bin slack over remaining lengths.

Every full window of a document is a sequence of its own. What remains of each document, less
than a window, goes with the remains of other documents. A group of remains is packed window
by window: the largest length left opens the window, then a bitset of reachable sums over the
multiset of the other lengths finds the fill closest to capacity, and walking the bitsets back
gives how often each length is used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyguard.llm.common import bounded_batches, free_name, written
from tallyguard.llm.tokens import token_bytes

CAPACITY = 2048
#: Remains in a group, on average. Each group leaves one window open, so its padding is small.
GROUP_ROWS = 8192
#: Pieces in each of a worker's two tables; workers also carry what the stages before have left.
KEPT_PIECES = 250_000


def fill_counts(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """The sub-multiset of ``lengths`` whose sum is closest to, and not over, ``capacity``."""
    reach, whole = 1, (1 << (capacity + 1)) - 1
    steps = []
    for length in sorted((v for v in lengths if v <= capacity), reverse=True):
        left, take = min(lengths[length], capacity // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & whole
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length, the number of its window and its offset there."""
    order = np.argsort(-lengths, kind="stable")
    rows: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        rows.setdefault(int(lengths[i]), []).append(i)
    left = {length: len(r) for length, r in rows.items()}
    window = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    number = 0
    while left:
        largest = max(left)
        left[largest] -= 1
        used = fill_counts({v: n for v, n in left.items() if n}, capacity - largest)
        used[largest] = used.get(largest, 0) + 1
        left[largest] += 1
        # The same fill serves as long as the lengths last.
        for _ in range(min(left[v] // n for v, n in used.items())):
            at = 0
            for v, n in used.items():
                for _ in range(n):
                    i = rows[v].pop()
                    window[i], offset[i] = number, at
                    at += v
                left[v] -= n
            number += 1
        for v in used:
            if not left[v]:
                del left[v]
    return window, offset


def cut_pieces(
    df: DataFrame, path: str, key: str, text: str, end_id: int, capacity: int
) -> DataFrame:
    """One row per window or remain of each document, with the checksum of its ids."""
    end = np.asarray([end_id], "<u4").tobytes()
    kind = df.schema[key].dataType.simpleString()
    wide = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, start, length, check, total = [], [], [], [], []
            for row, ids in enumerate(token_bytes(batch.column(1), path, KEPT_PIECES)):
                ids += end
                for at in range(0, len(ids), wide):
                    piece = ids[at : at + wide]
                    place.append(row)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    check.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place, pa.int64())),
                    *(pa.array(v, pa.int64()) for v in (start, length, check, total)),
                ],
                [key, "start", "length", "ids_crc32", "doc_tokens"],
            )

    return df.select(F.col(f"`{key}`").alias(key), F.col(text).cast("string")).mapInArrow(
        pieces, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_documents(
    df: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Every id of every document, and ``end_id`` after each, in sequences of ``capacity``.

    One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null
    or empty text is its end id alone. Repeated rows are documents of their own, null keys are
    kept, and an empty table gives no pieces. Other columns take no part.
    """
    bounded_batches(df.sparkSession, 4096)
    pieces = written(cut_pieces(df, path, key, text, end_id, capacity))
    row = free_name(pieces, "_row")
    numbered = pieces.withColumn(row, F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity)
    open_ = numbered.where(F.col("length") < capacity)
    groups = max(1, -(-open_.count() // group_rows))
    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows[row].iloc[0] % groups)
        window, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(group << 32) + window, offset=offset).drop(columns=row)

    packed = open_.groupBy((F.col(row) % groups).alias("_group")).applyInPandas(pack, schema)
    alone = full.select(
        *pieces.columns,
        # Behind all numbers of groups.
        (F.col(row) + F.lit(1 << 62)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(alone)
