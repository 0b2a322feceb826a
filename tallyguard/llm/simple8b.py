"""Token ids as files of word-aligned codes, and back.

File format. A table of blocks, written by Spark's Parquet writer, so that a lost task leaves
no half file; each block is one binary value and can be read alone:

    4 bytes   b"S8W1"
    4 x u32   documents D, chunks C, words W, reserved
    u64       ids of all blocks before it in its shard
    D x i64   keys of the documents (a null key is the smallest 64-bit number)
    D x u64   ids of each document, its end id included
    C x u32   place of each chunk's first word
    W x u64   words

All numbers are little-endian. A chunk is 32,768 ids of the block (the last may be shorter). A
word has a selector in its top four bits and 60 bits of payload, first id lowest. Selector s
from 1 to 14 holds PER_WORD[s] ids of equal width; selector 0 is an escape: the next word is
one id of up to 64 bits. A chunk's last word may hold zeros beyond its ids. Because chunks
start at known words, all words of a block with the same selector are decoded at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import bounded_batches
from tallyguard.llm.tokens import token_bytes
from tallyguard.session import shared_folder

MAGIC = b"S8W1"
CHUNK = 32768
BLOCK_IDS = 1 << 18
#: Fixed values of the code: ids in a word by selector; selector 0 is the escape.
PER_WORD = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = 60 // PER_WORD
_NULL_KEY = -(1 << 63)


def _width_of(ids: np.ndarray) -> np.ndarray:
    """The narrowest width of the code that holds each id; 61 if none does."""
    widths = sorted(set(WIDTH[1:].tolist()))
    limits = np.array([1 << w for w in widths], np.uint64)
    return np.array([*widths, 61], np.uint8)[np.searchsorted(limits, ids, "right")]


_SMALL_WIDTH = _width_of(np.arange(1 << 16, dtype=np.uint64))


def _chosen(ids: np.ndarray) -> np.ndarray:
    """For each place, the selector of the word with the most ids that can start there."""
    n = len(ids)
    width = np.zeros(n + 64, np.uint8)
    width[:n] = _SMALL_WIDTH[ids.astype(np.int64)] if ids.max() < len(_SMALL_WIDTH) else _width_of(ids)
    spans = {1: width}
    size = 1
    while size < 32:
        wide = spans[size].copy()
        wide[:-size] = np.maximum(wide[:-size], spans[size][size:])
        spans[size * 2] = wide
        size *= 2
    best = np.zeros(n, np.uint8)
    for selector in range(len(PER_WORD) - 1, 0, -1):
        count = int(PER_WORD[selector])
        power = 1 << (count.bit_length() - 1)
        top = np.maximum(spans[power][:n], spans[power][count - power : count - power + n])
        best[top <= int(WIDTH[selector])] = selector
    return best


def encode_words(ids: np.ndarray) -> np.ndarray:
    """The words of one chunk."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    best = _chosen(ids)
    step = PER_WORD.astype(np.uint8)[best].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == 0)[:-1]])
    words = np.zeros(int(place[-1]) + 1 + int(chosen[-1] == 0), np.uint64)
    padded = np.concatenate([ids, np.zeros(64, np.uint64)])
    for selector in np.flatnonzero(np.bincount(chosen)).tolist():
        mine = chosen == selector
        at, to = starts[mine], place[mine]
        if selector == 0:
            words[to + 1] = ids[at]
            continue
        word = np.full(len(at), np.uint64(selector << 60), np.uint64)
        for j in range(int(PER_WORD[selector])):
            word |= padded[at + j] << np.uint64(j * int(WIDTH[selector]))
        words[to] = word
    return words


def encode_block(keys: list, texts_ids: list[np.ndarray], before: int) -> bytes:
    """One block of the file format."""
    ids = np.concatenate(texts_ids) if texts_ids else np.zeros(0, np.uint64)
    chunks = [encode_words(ids[a : a + CHUNK]) for a in range(0, len(ids), CHUNK)]
    places = np.cumsum([0, *map(len, chunks)])
    return b"".join(
        [
            MAGIC,
            struct.pack("<4IQ", len(keys), len(chunks), int(places[-1]), 0, before),
            np.array([_NULL_KEY if k is None else k for k in keys], "<i8").tobytes(),
            np.array([len(t) for t in texts_ids], "<u8").tobytes(),
            places[:-1].astype("<u4").tobytes(),
            *(c.astype("<u8").tobytes() for c in chunks),
        ]
    )


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Keys, lengths, all ids, and the number of ids before the block in its shard."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    documents, chunks, size, _, before = struct.unpack_from("<4IQ", block, 4)
    at = 4 + struct.calcsize("<4IQ")
    keys = np.frombuffer(block, "<i8", documents, at)
    lengths = np.frombuffer(block, "<u8", documents, at + 8 * documents).astype(np.int64)
    at += 16 * documents
    places = np.frombuffer(block, "<u4", chunks, at).astype(np.int64)
    words = np.frombuffer(block, "<u8", size, at + 4 * chunks).astype(np.uint64)
    total = int(lengths.sum())
    if not size:
        return keys, lengths, np.zeros(0, np.uint64), before
    selector = (words >> np.uint64(60)).astype(np.int64)
    if not selector.all():
        # The word after an escape is an id, whatever its top bits say.
        at_escape, last = np.flatnonzero(selector == 0), -2
        raw = np.zeros(size, bool)
        for i in at_escape.tolist():
            if last != i - 1:
                raw[i + 1], last = True, i
    else:
        raw = np.zeros(size, bool)
    code = np.flatnonzero(~raw)
    counts = PER_WORD[selector[code]]
    chunk = np.searchsorted(places, code, "right") - 1
    begun = np.cumsum(counts) - counts
    first = begun[np.searchsorted(code, places)]
    start = begun - first[chunk] + chunk * CHUNK
    out = np.zeros(total + 64, np.uint64)
    kinds = selector[code]
    # What a chunk's last word holds beyond its ids is left out.
    ends = np.minimum((chunk + 1) * CHUNK, total)
    for s in np.flatnonzero(np.bincount(kinds)).tolist():
        mine = kinds == s
        to, end = start[mine], ends[mine]
        if s == 0:
            out[to] = words[code[mine] + 1]
            continue
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        word = words[code[mine]]
        full = bool((to + int(PER_WORD[s]) <= end).all())
        for j in range(int(PER_WORD[s])):
            value = (word >> np.uint64(j * int(WIDTH[s]))) & mask
            if full:
                out[to + j] = value
            else:
                inside = to + j < end
                out[to[inside] + j] = value[inside]
    return keys, lengths, out[:total], before


def write_token_files(
    df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> str:
    """Write the ids of all texts in ascending ``key`` order; returns the folder.

    Each document's ids are followed by ``end_id``; a null or empty text is that id alone.
    Rows with the same key stand side by side, null keys first. A shard is one task's range of
    keys; its blocks follow each other and hold whole documents.
    """
    spark = df.sparkSession
    bounded_batches(spark, 4096)
    path = f"{shared_folder(spark)}/llm/ids-{uuid.uuid4().hex}"
    sorted_ = (
        df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(text).cast("string").alias("t"))
        .repartitionByRange(F.col("k").asc_nulls_first())
        .sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        keys, ids, held, before, number = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            data = encode_block(keys, ids, before)
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "block": [number], "n_ids": [held], "data": [data]},
                schema=pa.schema(
                    [("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]
                ),
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, data in zip(names, token_bytes(batch.column(1), tokenizer)):
                keys.append(name)
                ids.append(np.frombuffer(data + end, "<u4").astype(np.uint64))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    before, number = before + held, number + 1
                    keys, ids, held = [], [], 0
        if keys:
            yield block()

    sorted_.mapInArrow(encode, "shard int, block long, n_ids long, data binary").write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: key, start, n_tokens, ids (array) in file order."""
    return _documents(spark, path, "array<long>", lambda ids: ids.astype(np.int64))


def read_token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: key, start, n_tokens, ids_crc32."""
    return _documents(spark, path, "long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _documents(spark: SparkSession, path: str, kind: str, value) -> DataFrame:
    blocks = spark.read.schema("shard int, block long, n_ids long, data binary").parquet(path)
    # One number for each shard, of which there are as many as tasks that wrote.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    begins, total = {}, 0
    for row in sizes:
        begins[row["shard"]] = total
        total += row["n"]
    name = "ids" if kind.startswith("array") else "ids_crc32"
    out = pa.list_(pa.int64()) if kind.startswith("array") else pa.int64()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, lengths, ids, before = decode_block(data.as_py())
                ends = np.cumsum(lengths)
                values = [value(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64(), mask=keys == _NULL_KEY),
                        pa.array(begins[shard] + before + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(values, out),
                    ],
                    ["doc_id", "start", "n_tokens", name],
                )

    return blocks.select("shard", "data").mapInArrow(
        decode, f"doc_id long, start long, n_tokens long, {name} {kind}"
    )
