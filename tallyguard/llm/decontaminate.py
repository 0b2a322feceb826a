"""Benchmark decontamination: word windows of benchmark items, found in whole documents.

The windows of all items go to every worker as one hash table. That copy is only made of a
slice of the items whose text is at most ``slice_bytes``; a larger benchmark is scanned for
in several slices, one after the other. A window's hash that occurs is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.common import free_name, written

WINDOW = 10
#: Bytes of item text whose windows are sent to each worker at once.
SLICE_BYTES = 32 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words on UTF-8 bytes: all bytes of characters from U+0080 on are word bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words: A-Z lowered, cut at every other ASCII character but 0-9 and a-z."""
    return _WORD.findall(text.encode().translate(_LOWER)) if text else []


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` ids."""
    n = len(ids) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = (out + ids[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class WindowTable:
    """The windows of a slice of items: by size, sorted hashes and the words behind them."""

    def __init__(self, items: list[tuple], window: int):
        self.number: dict[bytes, int] = {}
        self.holders: dict[tuple, list] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                holders = self.holders.setdefault(tuple(words[at : at + size]), [])
                if item not in holders:
                    holders.append(item)
        by_size: dict[int, list] = {}
        for run in self.holders:
            by_size.setdefault(len(run), []).append(run)
        self.hashes = {
            size: np.unique(_rolled(np.array(runs, np.uint64).ravel(), size)[::size])
            for size, runs in by_size.items()
        }

    def hits(self, text: str | None) -> tuple[int, np.ndarray, list]:
        """The number of words, which words are hit, and the items with occurring windows."""
        words = words_of(text)
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        hit = np.zeros(len(words), bool)
        items: set = set()
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            rolled = _rolled(ids, size)
            place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for at in np.flatnonzero(hashes[place] == rolled).tolist():
                holders = self.holders.get(tuple(ids[at : at + size].tolist()))
                if holders:
                    hit[at : at + size] = True
                    items.update(holders)
        return len(words), hit, sorted(items)


def runs_of(hit: np.ndarray) -> list[list[int]]:
    """[first, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def mark_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with ``n_words``, ``hit_runs`` and ``hit_items``; columns so named are replaced.

    ``hit_runs`` are [first, end) word numbers, merged; ``hit_items`` the sorted ids of items
    with a window in the text. A null or empty text has no words. Items without words have no
    window, repeated items count once, an empty benchmark hits nothing, and null item ids are
    left out.
    """
    new = {"n_words", "hit_runs", "hit_items"}
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    items = benchmark.select(
        F.col(f"`{item}`").cast("long").alias("item"), F.col(item_text).cast("string").alias("text")
    ).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Twice the slices that the mean asks for, since items are dealt by hash.
    slices = 1 if size <= slice_bytes else -(-2 * size // slice_bytes)
    runs, found = free_name(df, "_runs"), free_name(df, "_found")
    out = df.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            runs: F.array().cast("array<struct<a:int,b:int>>"),
            found: F.array().cast("array<long>"),
        }
    )
    for part in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == part)
        rows = [tuple(r) for r in mine.distinct().collect()]
        out = _scan(out, rows, text, runs, found, window)
        if part + 1 < slices:
            out = written(out)
    return out.withColumnsRenamed({runs: "hit_runs", found: "hit_items"})


def _scan(df: DataFrame, rows: list[tuple], text: str, runs: str, found: str, window: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rows)
    made: list[WindowTable] = []
    names, schema = df.columns, df.schema
    at_text, at_words, at_runs, at_found = (names.index(c) for c in (text, "n_words", runs, found))
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(WindowTable(shared.value, window))
        for batch in batches:
            before = zip(batch.column(at_runs).to_pylist(), batch.column(at_found).to_pylist())
            counts, spans, items = [], [], []
            for value, (old_runs, old_items) in zip(batch.column(at_text).to_pylist(), before):
                n, hit, mine = made[0].hits(value)
                for run in old_runs:
                    hit[run["a"] : run["b"]] = True
                counts.append(n)
                spans.append([{"a": a, "b": b} for a, b in runs_of(hit)])
                items.append(sorted({*old_items, *mine}))
            columns = list(batch.columns)
            columns[at_words] = pa.array(counts, pa.int64())
            columns[at_runs] = pa.array(spans, run_type)
            columns[at_found] = pa.array(items, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(scan, schema)


def without_spans(text: str | None, runs: list) -> str | None:
    """The text without the words of ``runs`` and what stands between them."""
    if text is None or not runs:
        return text
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_LOWER))]
    kept, at = [], 0
    for run in runs:
        kept.append(data[at : places[run["a"]][0]])
        at = places[run["b"] - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``df`` without hit documents (``remove="documents"``) or hit spans (``"spans"``)."""
    marked = mark_contamination(df, benchmark, text, item, item_text, window)
    if remove == "documents":
        return marked.where(F.size("hit_runs") == 0).select(*[f"`{c}`" for c in df.columns])
    names, schema = df.columns, df.schema
    at = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[:-1]
            texts = map(without_spans, columns[at].to_pylist(), batch.column(len(names)).to_pylist())
            columns[at] = pa.array(list(texts), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.select(*[f"`{c}`" for c in names], "hit_runs").mapInArrow(cut, schema)
