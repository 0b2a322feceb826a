"""Removal of long byte strings that occur more than once, by suffix arrays.

A window is a string of ``length`` bytes. Its anchor is the leftmost 32-byte string in it with
the smallest hash, so equal windows have their anchors at equal places. Anchors that occur once
settle their windows at once. For the others, window starts are dealt into classes of 64 by
their distance from the anchor; all windows of a class share a core of bytes, and only the 63
bytes before and behind it differ between them. Classes meet in Spark by the core's hash:

* a class whose core occurs nowhere else holds no repeated window;
* a class that occurs again with the same bytes around it is repeated as a whole;
* where cores agree and surroundings differ, suffix arrays by linear grouping (suffixes.py) sort
  the bytes behind the cores and, reversed, those before them. Common prefixes of neighbours
  then say for every window which others agree with it on both sides.

Cores with very many surroundings are not gathered: their windows are counted one by one by a
grouped sum. Equal texts are looked at once. Hashes of 128 bits stand for cores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.common import free_name, sent_if_few, written
from tallyguard.llm.suffixes import suffix_array

LENGTH = 400
GRAM = 32
CLASS = 64
SIDE = CLASS - 1
#: Surroundings of one core that a task sorts; with more, windows are counted.
GATHERED = 4096
#: Surroundings sorted by one suffix array.
SORTED_ROWS = 1500
#: Bytes of a symbol; a side is nine of them.
SYMBOL = 7

_BITS = 20
_PLACE = np.uint64((1 << _BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    x, size, factor = _BYTE[data], 1, int(_MIX)
    while size < GRAM:
        x = x[:-size] * np.uint64(factor) + x[size:]
        factor = factor * factor % (1 << 64) + 2
        size *= 2
    return _mixed(x)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, from running minima of blocks."""
    n = len(x) - size + 1
    blocks = np.full(-(-len(x) // size) * size, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def anchor_runs(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, rows (anchor, first start, last start, hash of the anchor)."""
    parts, out = [], [[] for _ in texts]
    most = 1 << _BITS
    for number, data in enumerate(texts):
        at = 0
        while at + length <= len(data):
            parts.append((number, at, data[at : at + most]))
            at += most - length + 1
    start = 0
    while start < len(parts):
        end, total = start, 0
        while end < len(parts) and total + len(parts[end][2]) <= most:
            total += len(parts[end][2])
            end += 1
        _runs_of(parts[start:end], out, length)
        start = end
    empty = np.zeros((0, 4), np.int64)
    return [_joined(rows) if len(rows) > 1 else rows[0] if rows else empty for rows in out]


def _joined(rows: list[np.ndarray]) -> np.ndarray:
    """Runs of the parts of a long text; a run cut at a part's end becomes one again."""
    all_ = np.concatenate(rows)
    same = (all_[1:, 0] == all_[:-1, 0]) & (all_[1:, 1] == all_[:-1, 2] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], len(all_)) - 1
    merged = all_[first].copy()
    merged[:, 2] = all_[last, 2]
    return merged


def _runs_of(parts: list, out: list, length: int) -> None:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(ranked, length - GRAM + 1)
    anchor = (least & _PLACE).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
    whole = np.flatnonzero(np.arange(len(anchor)) + length <= (begins + sizes)[part])
    anchor, part = anchor[whole], part[whole]
    first = np.flatnonzero(
        np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
    )
    last = np.append(first[1:], len(anchor)) - 1
    own = part[first]
    shift = np.array([p[1] for p in parts])[own] - begins[own]
    rows = np.stack(
        [anchor[first] + shift, whole[first] + shift, whole[last] + shift, hashes[anchor[first]].view(np.int64)], 1
    )
    for number, run in zip(range(len(parts)), np.split(rows, np.searchsorted(own, np.arange(1, len(parts))))):
        out[parts[number][0]].append(run)


def classes_of(data: bytes, runs: list, length: int) -> Iterator[tuple]:
    """(k1, k2, surroundings' hash, right, r0, r1, left, tail) of each class of the runs.

    ``right`` is the class's last window start; r0 to r1 are the distances of the run's starts
    from it."""
    core_size = length - SIDE
    for anchor, first, last in runs:
        for j in range((anchor - last) // CLASS, (anchor - first) // CLASS + 1):
            right = anchor - j * CLASS
            behind = right + core_size
            left, tail = data[max(0, right - SIDE) : right], data[behind : behind + SIDE]
            key = xxhash.xxh3_128_intdigest(data[right:behind], j)
            around = xxhash.xxh3_64_intdigest(left + tail, len(left))
            r0, r1 = right - min(last, right), right - max(first, right - SIDE)
            yield _signed(key >> 64), _signed(key & _ALL), _signed(around), right, r0, r1, left, tail


_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _side(rows: list[bytes], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row from the core outwards, padded, and how many there are."""
    padded = np.zeros((len(rows), SIDE), np.uint8)
    sizes = np.array([len(r) for r in rows])
    joined = np.frombuffer(b"".join(r[::-1] if backwards else r for r in rows), np.uint8)
    padded[np.arange(SIDE) < sizes[:, None]] = joined
    return padded, sizes


def repeated_offsets(group: np.ndarray, left: list[bytes], tail: list[bytes], n: np.ndarray) -> np.ndarray:
    """For each row a mask of the distances r whose window occurs at least twice.

    Rows of one ``group`` share the core; ``n`` says how often a row occurs. The window at
    distance r takes the r bytes before the core and the first SIDE - r behind it."""
    rows = len(group)
    sides = [_side(tail, False), _side(left, True)]
    per = SIDE // SYMBOL
    text = np.full((rows, 2, per + 2), -1, np.int64)
    for s, (padded, _) in enumerate(sides):
        text[:, s, 0] = (1 << 60) + 2 * group + s
        number = np.zeros((rows, per), np.int64)
        for b in range(SYMBOL):
            number = (number << 8) | padded[:, b::SYMBOL]
        text[:, s, 1 : 1 + per] = number
    # Only suffixes that start at a core's side are of use; they come in order of their bytes.
    order = np.array(suffix_array(text.ravel()))
    order = order[order % (per + 2) == 0] // (per + 2)
    shared = []
    for s, (padded, _) in enumerate(sides):
        mine = order[order % 2 == s] // 2
        differ = padded[mine[1:]] != padded[mine[:-1]]
        common = np.where(differ.any(1), differ.argmax(1), SIDE)
        common[group[mine[1:]] != group[mine[:-1]]] = -1
        shared.append((mine, common))

    def classes(s: int, depth: int) -> np.ndarray:
        mine, common = shared[s]
        out = np.empty(rows, np.int64)
        out[mine] = np.concatenate([[0], np.cumsum(common < depth)])
        return out

    mask = np.zeros(rows, np.uint64)
    for r in range(CLASS):
        there = np.flatnonzero((sides[0][1] >= SIDE - r) & (sides[1][1] >= r))
        if len(there):
            both = classes(0, SIDE - r)[there] * rows + classes(1, r)[there]
            _, inverse = np.unique(both, return_inverse=True)
            often = np.bincount(inverse, weights=n[there])[inverse] >= 2
            mask[there[often]] |= np.uint64(1 << r)
    return mask.view(np.int64)


def spans_of(size: int, records: list, length: int) -> list[tuple[int, int]]:
    """Maximal [start, end) of bytes covered by the repeated windows of one text."""
    steps = np.zeros(size + 1, np.int64)
    for right, r0, r1, mask in records:
        if mask == -1:
            steps[right - r1] += 1
            steps[right - r0 + length] -= 1
        else:
            for r in range(r0, r1 + 1):
                if mask >> r & 1:
                    steps[right - r] += 1
                    steps[right - r + length] -= 1
    covered = np.cumsum(steps[:size]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(map(tuple, edges.reshape(-1, 2).tolist()))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def _anchored(texts: DataFrame, length: int) -> DataFrame:
    """(digest, n_bytes, id, runs) per row, the runs as flat quadruples."""
    kind = texts.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.encode() for t in batch.column(1).to_pylist()]
            runs = [r.ravel() for r in anchor_runs(data, length)]
            ends = np.cumsum([0, *map(len, runs)])
            values = pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()),
                    pa.array([len(d) for d in data], pa.int64()),
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                ],
                ["digest", "n_bytes", "id", "runs"],
            )

    return texts.mapInArrow(scan, f"digest binary, n_bytes long, id {kind}, runs array<long>")


def _with_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (digest, first, ...) with the text of one row that has the digest."""
    ids = texts.join(sent_if_few(wanted.select(F.col("first").alias("id")).distinct()), "id", "left_semi")
    named = ids.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # Rows that repeat both id and text are one and the same here.
    return named.join(wanted, "digest").where("id <=> first").dropDuplicates(["node"])


def find_repeats(df: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """All rows as (digest, n_bytes, id), and (digest, copies, records) of each distinct text:
    its repeated windows as (right, r0, r1, mask), null if there are none."""
    texts = _texts(df, key, text)
    rows = written(_anchored(texts, length))
    once = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), F.first("runs").alias("runs")
    )
    once = written(once.withColumn("node", F.monotonically_increasing_id()))
    at = lambda i, j: F.element_at("runs", 4 * i + j)
    runs = once.where(F.size("runs") > 0).select(
        "node",
        F.inline(
            F.transform(
                F.sequence(F.lit(0), (F.size("runs") / 4).cast("int") - 1),
                lambda i: F.struct(
                    at(i, 1).alias("anchor"), at(i, 2).alias("first"), at(i, 3).alias("last"), at(i, 4).alias("gram")
                ),
            )
        ),
    )
    # Written, so that the join below has two shuffled sides and a hot anchor's rows can be split.
    often = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    often = written(often.where("n > 1").select("gram"))
    per_text = (
        runs.join(often, "gram")
        .groupBy("node")
        .agg(F.collect_list(F.struct("anchor", "first", "last")).alias("open"))
    )
    wanted = written(per_text.join(once.select("node", "digest", "first"), "node"))
    # A null id cannot be looked up by equality, so such rows are looked up by digest alone.
    known = _with_texts(texts.where("id is not null"), wanted.where("first is not null"))
    lost = texts.where("id is null").withColumn("digest", F.unhex(F.sha2("text", 256)))
    lost = lost.join(wanted.where("first is null"), "digest").dropDuplicates(["node"])
    found = known.select("node", "text", "open").unionByName(lost.select("node", "text", "open"))
    classes = written(_classes(found, length))
    narrow = classes.select("node", "k1", "k2", "c", "right", "r0", "r1")
    masks = _masks(classes)
    records = (
        narrow.join(masks, ["k1", "k2", "c"])
        .groupBy("node")
        .agg(F.collect_list(F.struct("right", "r0", "r1", "mask")).alias("records"))
    )
    return rows.drop("runs"), once.drop("runs").join(records, "node", "left")


def _classes(found: DataFrame, length: int) -> DataFrame:
    names = ["node", "k1", "k2", "c", "right", "r0", "r1", "left", "tail"]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(nodes), 64):
                out = []
                for row in range(a, min(a + 64, len(nodes))):
                    runs = [(o["anchor"], o["first"], o["last"]) for o in batch.column(2)[row].as_py()]
                    out += [(nodes[row], *c) for c in classes_of(texts[row].encode(), runs, length)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out), kinds)], names
                )

    return found.select("node", "text", "open").mapInArrow(
        cut, "node long, k1 long, k2 long, c long, right long, r0 int, r1 int, left binary, tail binary"
    )


def _masks(classes: DataFrame) -> DataFrame:
    """(k1, k2, c, mask) of the classes with repeated windows."""
    core = ["k1", "k2"]
    kinds = written(classes.groupBy("k1", "k2", "c").agg(F.count(F.lit(1)).alias("n")))
    cores = kinds.groupBy(*core).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    open_ = sent_if_few(kinds.join(cores, core))
    sides = classes.select("k1", "k2", "c", "left", "tail").join(open_, ["k1", "k2", "c"])
    sides = written(sides.dropDuplicates(["k1", "k2", "c"]))
    whole = kinds.where("n > 1").select("k1", "k2", "c", F.lit(-1).cast("long").alias("mask"))
    part = _sorted_masks(sides.where(F.col("m") <= GATHERED)).unionByName(
        _counted_masks(sides.where(F.col("m") > GATHERED))
    )
    both = whole.unionByName(part.where("mask <> 0"))
    return written(both.groupBy("k1", "k2", "c").agg(F.bit_or("mask").alias("mask")))


def _sorted_masks(sides: DataFrame) -> DataFrame:
    names = ["k1", "k2", "c", "n", "left", "tail"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solved(rows: list[tuple]) -> pa.RecordBatch:
            k1, k2, c, n, left, tail = zip(*rows)
            numbers = {key: i for i, key in enumerate(dict.fromkeys(zip(k1, k2)))}
            group = np.array([numbers[key] for key in zip(k1, k2)])
            mask = repeated_offsets(group, list(left), list(tail), np.array(n))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(v, pa.int64()) for v in (k1, k2, c)), pa.array(mask)], ["k1", "k2", "c", "mask"]
            )

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if len(held) >= SORTED_ROWS and row[:2] != held[-1][:2]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    return (
        sides.select(*names)
        .repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2")
        .mapInArrow(solve, "k1 long, k2 long, c long, mask long")
    )


def _counted_masks(sides: DataFrame) -> DataFrame:
    """Masks of cores with very many surroundings: every window is counted by itself."""
    windows = sides.select(
        "k1", "k2", "c", "n", "left", "tail", F.explode(F.sequence(F.lit(0), F.lit(SIDE))).alias("r")
    ).where((F.octet_length("left") >= F.col("r")) & (F.octet_length("tail") >= SIDE - F.col("r")))
    before = F.expr("substring(left, octet_length(left) - r + 1, r)")
    behind = F.expr(f"substring(tail, 1, {SIDE} - r)")
    windows = windows.select("k1", "k2", "c", "n", "r", F.concat(before, behind).alias("around"))
    same = ["k1", "k2", "r", "around"]
    often = windows.groupBy(*same).agg(F.sum("n").alias("times")).where("times > 1").drop("times")
    return (
        windows.join(often, same)
        .groupBy("k1", "k2", "c")
        .agg(F.bit_or(F.expr("shiftleft(1L, r)")).alias("mask"))
    )


def _removed(texts_with_records: DataFrame, length: int, schema: str, value) -> DataFrame:
    """mapInArrow over (x, text, records): ``value(x, data, spans)`` gives a row."""
    names = [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                records = batch.column(2)[row].as_py() or []
                data = text.encode()
                found = [(r["right"], r["r0"], r["r1"], r["mask"]) for r in records]
                out.append(value(batch.column(0)[row].as_py(), data, spans_of(len(data), found, length)))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    return texts_with_records.mapInArrow(cut, schema)


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for span in spans for e in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def count_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in
    the same text or another. Null is the empty text; texts shorter than ``length`` stay;
    repeated rows are each other's repeats, also under one key; null keys are kept; an empty
    table gives an empty table. Other columns are not read.
    """
    rows, repeats = find_repeats(df, key, text, length)
    repeats = written(repeats)
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    alone = repeats.where("copies = 1 and records is not null")
    texts = _texts(df, key, text)
    known = _with_texts(texts.where("id is not null"), alone.where("first is not null"))
    lost = texts.where("id is null").withColumn("digest", F.unhex(F.sha2("text", 256)))
    lost = lost.join(alone.where("first is null"), "digest")
    wanted = ["digest", "text", "records"]
    counted = _removed(
        known.select(*wanted).unionByName(lost.select(*wanted)),
        length,
        "digest binary, n_removed long, n_spans long, kept_sha256 string",
        lambda x, data, spans: (
            x, sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()
        ),
    )
    found = repeats.select("digest", "copies").join(counted, "digest", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(found, "digest").select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, nothing)
        .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
        .alias("kept_sha256"),
    )


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with repeated strings cut out of ``text``; what a cut leaves of a character goes
    too. Null stays null."""
    _, repeats = find_repeats(df, key, text, length)
    repeats = written(repeats.select("digest", "copies", "records"))
    digest, clean = free_name(df, "_digest"), free_name(df, "_clean")
    named = df.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)))
    inputs = named.where(F.col(text).isNotNull()).select(F.col(digest).alias("digest"), F.col(text).cast("string").alias("text"))
    partly = inputs.join(repeats.where("copies = 1 and records is not null"), "digest")
    cut = _removed(
        partly.select("digest", "text", "records"),
        length,
        f"{digest} binary, {clean} string",
        lambda x, data, spans: (x, _kept(data, spans).decode(errors="ignore")),
    )
    copies = free_name(df, "_copies")
    counts = repeats.select(F.col("digest").alias(digest), F.col("copies").alias(copies))
    gone = (F.col(copies) > 1) & (F.octet_length(text) >= length)
    joined = named.join(counts, digest, "left").join(cut, digest, "left")
    new = F.when(gone, F.lit("")).otherwise(F.coalesce(F.col(clean), F.col(text).cast("string")))
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), new)).select(*[f"`{c}`" for c in df.columns])
