"""Stupid-backoff scores of documents under the bigram model of all of them.

Tokens are ids of a public tokenizer, with a start mark before and an end mark behind each
document. Every batch of documents is exploded into its bigrams; a row is a bigram of the
batch with the documents that hold it, once for each time. These rows are partitioned by
bigram; the count table is summed there and joined back to them, and the counts of single
tokens, at most as many as the tokenizer has, are sent to all workers. The joined rows carry
the two counts that make a score; as small whole numbers they are packed a little better on
their way than the score is. What each task adds up for a document is summed per document.

    score(a b) = count(a b) / count(a)          if count(a b) >= least
                 backoff * count(b) / total     otherwise
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.common import bounded_batches, written
from tallyguard.llm.tokens import token_bytes

#: Tokens and documents of a batch; a longer document is a batch alone.
BATCH_TOKENS = 3_000_000
BATCH_DOCUMENTS = 1 << 16
#: Occurrences added up at once.
ADDED_ROWS = 3_000_000
#: Bits of a token id, the start mark and the end mark.
BITS = 20
START, END = (1 << BITS) - 1, (1 << BITS) - 2
_NO_KEY = -(1 << 63)


def bigram_rows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct bigrams of a batch, their counts, and the documents behind them."""
    keys = []
    for number, tokens in enumerate(ids):
        marked = np.empty(len(tokens) + 2, np.int64)
        marked[0], marked[1:-1], marked[-1] = START, tokens, END
        keys.append(((marked[:-1] << BITS | marked[1:]) << 16) | number)
    keys = np.sort(np.concatenate(keys).view(np.uint64))
    grams = (keys >> np.uint64(16)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams))), (keys & np.uint64(0xFFFF)).astype("<u2")


def _exploded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (gram, batch, times, documents); a batch's first row, with a negative gram of its
    own, lists its documents' keys and lengths."""
    names = ["gram", "batch", "times", "documents"]

    def rows(batch: int, names_: list, ids: list) -> Iterator[pa.RecordBatch]:
        about = np.array([[k, len(t)] for k, t in zip(names_, ids)], np.int64).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (-1 - batch, batch, 0)] + [pa.array([about], pa.binary())], names
        )
        grams, times, documents = bigram_rows(ids)
        ends = np.concatenate([[0], np.cumsum(times)])
        for a in range(0, len(grams), 1 << 16):
            b = min(a + (1 << 16), len(grams))
            part = documents[ends[a] : ends[b]]
            offsets = ((ends[a : b + 1] - ends[a]) * 2).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[a:b]), pa.array(np.full(b - a, batch)), pa.array(times[a:b]), packed], names
            )

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, ids, held = [], [], 0
        for batch in batches:
            texts_ids = token_bytes(batch.column(1), tokenizer)
            for key, data in zip(batch.column(0).to_pylist(), texts_ids):
                keys.append(_NO_KEY if key is None else key)
                ids.append(np.frombuffer(data, "<u4"))
                held += len(ids[-1])
                if held >= BATCH_TOKENS or len(ids) == BATCH_DOCUMENTS:
                    yield from rows(number, keys, ids)
                    keys, ids, held, number = [], [], 0, number + 1
        if ids:
            yield from rows(number, keys, ids)

    return texts.mapInArrow(explode, "gram long, batch long, times long, documents binary")


def log_scores(both: np.ndarray, base: np.ndarray, backoff: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of bigrams' scores, without the total for unseen ones, and which are unseen."""
    unseen = both < least
    return np.log(np.where(unseen, base * backoff, both / base)), unseen


def _added(joined: DataFrame, backoff: float, least: int) -> DataFrame:
    """Rows (batch, documents, both, base) as one row of sums per document.

    A row without counts is a batch's list of documents.

    A batch's rows are brought together first, so a document's sums are complete in one task
    and no partial sums per task and document are shuffled. A task holds two numbers for each
    document of its batches.
    """
    names = ["key", "n_tokens", "value", "unseen"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sums: dict[int, np.ndarray] = {}
        abouts: dict[int, np.ndarray] = {}

        def fold() -> None:
            batch, document, value, unseen = (np.concatenate(c) for c in zip(*held))
            for b in np.unique(batch).tolist():
                mine = batch == b
                at = document[mine].astype(np.int64)
                size = int(at.max()) + 1
                found = np.stack([np.bincount(at, v[mine], size) for v in (value, unseen)])
                known = sums.get(b)
                if known is None:
                    sums[b] = found
                elif known.shape[1] >= size:
                    known[:, :size] += found
                else:
                    found[:, : known.shape[1]] += known
                    sums[b] = found

        size = 0
        for rows in batches:
            head = rows.column(2).is_null().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(head).tolist():
                about = np.frombuffer(rows.column(1)[i].as_py(), np.int64).reshape(-1, 2)
                abouts[rows.column(0)[i].as_py()] = about
            real = rows.filter(pa.array(~head))
            if not real.num_rows:
                continue
            documents = [np.frombuffer(d, "<u2") for d in real.column(1).to_pylist()]
            times = np.array([len(d) for d in documents])
            value, unseen = log_scores(real.column(2).to_numpy(), real.column(3).to_numpy(), backoff, least)
            held.append(
                (
                    np.repeat(real.column(0).to_numpy(), times),
                    np.concatenate(documents),
                    np.repeat(value, times),
                    np.repeat(unseen.astype(float), times),
                )
            )
            size += int(times.sum())
            if size >= ADDED_ROWS:
                fold()
                held, size = [], 0
        if held:
            fold()
        for number, about in abouts.items():
            # Every document has a bigram, that of its marks at least.
            value, unseen = sums[number]
            columns = (about[:, 0], about[:, 1], value, unseen)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    together = joined.repartition("batch")
    return together.mapInArrow(add, "key long, n_tokens long, value double, unseen double")


def score_documents(
    df: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    backoff: float = 0.4,
    least: int = 2,
) -> DataFrame:
    """Per row: key, n_tokens, n_unseen, log_score (natural logarithm), mean_log_score.

    A document of n tokens has n + 1 bigrams; the mean is over these. A null or empty text is
    the bigram of both marks. Rows that repeat a key are documents of their own, null keys are
    kept, an empty table gives an empty table; other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark, 4096)
    texts = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # Written, because both the count table and the join read the exploded rows.
    rows = written(_exploded(texts, tokenizer), compression="zstd")
    counts = written(rows.where("gram >= 0").groupBy("gram").agg(F.sum("times").alias("both")))
    # One row per token of the tokenizer and the start mark: a bounded table.
    singles = F.broadcast(
        counts.groupBy(F.shiftright("gram", BITS).alias("token")).agg(F.sum("both").alias("single"))
    )
    before = singles.withColumnsRenamed({"token": "first", "single": "n_first"})
    behind = singles.withColumnsRenamed({"token": "second", "single": "n_second"})
    second = F.col("gram").bitwiseAND((1 << BITS) - 1)
    table = (
        counts.withColumn("first", F.shiftright("gram", BITS))
        # There are as many end marks as start marks.
        .withColumn("second", F.when(second == END, START).otherwise(second))
        .join(before, "first")
        .join(behind, "second")
        .select("gram", "both", F.when(F.col("both") < least, F.col("n_second")).otherwise(F.col("n_first")).alias("base"))
    )
    joined = rows.join(table, "gram", "left").select("batch", "documents", "both", "base")
    sums = written(_added(joined, backoff, least))
    total = sums.agg(F.sum(F.col("n_tokens") + 1)).first()[0] or 1
    score = F.col("value") - F.col("unseen") * math.log(total)
    return sums.select(
        F.when(F.col("key") != _NO_KEY, F.col("key")).alias(key),
        "n_tokens",
        F.col("unseen").cast("long").alias("n_unseen"),
        score.alias("log_score"),
        (score / (F.col("n_tokens") + 1)).alias("mean_log_score"),
    )
