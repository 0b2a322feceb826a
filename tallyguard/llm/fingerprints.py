"""Fingerprints of texts as sums of vectors, one wide vector per paragraph.

A paragraph's vector has two parts. The words, modulo 2**64, come from a cryptographic hash of
the whole paragraph; equal multisets of paragraphs, and practically no others, have equal sums.
The lanes, modulo 2**16, are a signed count sketch of the paragraph's word shingles; the
distance of two sums estimates how many shingles the texts do not share. Both parts add up, so
a paragraph is inserted or deleted by adding or subtracting its vector, in any order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.ordering import with_bucket
from tallyguard.operators.sketches import quantiles, size_for

#: Equality words of 64 bits, likeness lanes of 16 bits, words of a shingle.
WORDS, LANES, SHINGLE = 16, 256, 3
#: Bytes of text hashed at once, and of a piece of a longer paragraph.
CHUNK = 1 << 20
#: Bytes of text in one range of documents.
RANGE_BYTES = 256 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to n; kept per worker."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + CHUNK // 4)
        down = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", down)):
            steps = np.full(size, base, "uint64")
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype="uint64")
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range: differences of one running sum over the whole buffer."""
    up, down = _powers(len(data) + 1)
    running = np.zeros(len(data) + 1, "uint64")
    np.cumsum((data.astype("uint64") + np.uint64(1)) * up[: len(data)], dtype="uint64", out=running[1:])
    return _mixed((running[ends] - running[starts]) * down[starts])


def _lanes(data: np.ndarray, owner_ends: np.ndarray, lanes: int) -> np.ndarray:
    """Per owner the signed lane counts of the shingles of its paragraphs.

    ``data`` holds the paragraphs, each ended by a newline; ``owner_ends`` are the byte ends of
    the owners, whose paragraphs lie side by side.
    """
    owners = len(owner_ends)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[::2], edge[1::2]
    counts = np.zeros((owners, lanes), "int64")
    if not len(starts):
        return counts
    words = _word_hashes(data, starts, ends)
    paragraph = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
    owner = np.searchsorted(owner_ends, starts, side="right")
    first = np.concatenate(([True], paragraph[1:] != paragraph[:-1]))
    number = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(words)))
    # A shingle starts at each word that has enough followers, and at the first of a short paragraph.
    left = (begin + size)[number] - np.arange(len(words))
    starts_one = (left >= SHINGLE) | first
    at = np.flatnonzero(starts_one)
    shingle = np.zeros(len(at), "uint64")
    for step in range(SHINGLE):
        there = left[at] > step
        part = np.where(there, words[np.minimum(at + step, len(words) - 1)], np.uint64(step))
        shingle = _mixed(shingle * _ODD + part)
    lane = (shingle & np.uint64(lanes - 1)).astype("int64")
    sign = np.where(shingle >> np.uint64(63), 1.0, -1.0)
    flat = np.bincount(owner[at] * lanes + lane, sign, owners * lanes)
    return flat.astype("int64").reshape(owners, lanes)


def _pieces(paragraph: bytes) -> Iterator[bytes]:
    """The paragraph, or pieces of a long one, cut at the first white space behind a chunk."""
    at = 0
    while len(paragraph) - at > CHUNK:
        end = at + CHUNK
        stop = next((i for i in range(end, min(end + CHUNK, len(paragraph))) if _SPACE[paragraph[i]]), end)
        yield paragraph[at:stop]
        at = stop
    yield paragraph[at:]


def sums_of(texts: Sequence[Sequence[bytes]], words: int = WORDS, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Equality words and likeness lanes of each multiset of paragraphs (bytes)."""
    equal = np.zeros((len(texts), words), "uint64")
    like = np.zeros((len(texts), lanes), "uint16")
    buffer, owners, held = [], [], 0

    def flush() -> None:
        nonlocal buffer, owners, held
        if buffer:
            data = np.frombuffer(b"\n".join([*buffer, b""]), "uint8")
            sizes = np.cumsum([len(b) + 1 for b in buffer])
            mine, last = np.unique(owners, return_index=True)
            ends = sizes[np.append(last[1:], len(owners)) - 1]
            like[mine] += _lanes(data, ends, lanes).astype("uint16")
        buffer, owners, held = [], [], 0

    for i, paragraphs in enumerate(texts):
        if paragraphs:
            digests = b"".join([hashlib.shake_128(p).digest(8 * words) for p in paragraphs])
            equal[i] = np.frombuffer(digests, "<u8").reshape(-1, words).sum(0, dtype="uint64")
        for paragraph in paragraphs:
            for piece in _pieces(paragraph):
                buffer.append(piece)
                owners.append(i)
                held += len(piece) + 1
                if held >= CHUNK:
                    flush()
    flush()
    return equal, like


def paragraphs_of(text: str) -> list[bytes]:
    """Lines of a text; an empty text has none, and empty lines count."""
    return text.encode().split(b"\n") if text else []


def packed(equal: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints as base64 text: the equality words, then the lanes, little-endian."""
    return [base64.b64encode(e.astype("<u8").tobytes() + x.astype("<u2").tobytes()).decode() for e, x in zip(equal, like)]


def unpacked(fingerprint: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data[: 8 * words], "<u8").copy(), np.frombuffer(data[8 * words :], "<u2").copy()


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    return packed(*sums_of([paragraphs_of(text)]))[0]


def changed(before: str, deleted: Sequence[str] = (), inserted: Sequence[str] = ()) -> str:
    """The fingerprint after paragraphs left and came, without the text they were in."""
    equal, like = unpacked(before)
    for lines, sign in ((deleted, -1), (inserted, 1)):
        more_equal, more_like = sums_of([[p.encode() for p in lines]])
        equal = equal - more_equal[0] if sign < 0 else equal + more_equal[0]
        like = like - more_like[0] if sign < 0 else like + more_like[0]
    return packed(equal[None], like[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per row 0 to 1: about twice the shared shingles over all shingles of both; 1 if equal.

    ``a`` and ``b`` are (equality words, lanes) of the same rows. The lanes' squared length
    estimates the (squared) multiplicities of shingles, with a relative error near
    sqrt(2 / lanes). Differences are taken in the ring, so a lane may wrap; texts in which
    one shingle occurs over 32,767 times are only compared roughly.
    """
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    lengths = sum((x[1].view("int16").astype("float64") ** 2).sum(axis=1) for x in (a, b))
    apart = ((a[1] - b[1]).view("int16").astype("float64") ** 2).sum(axis=1)
    value = np.clip(1.0 - apart / np.where(lengths > 0, lengths, 1.0), 0.0, 1.0)
    return np.where(same, 1.0, np.where(lengths > 0, value, 0.0))


def _compared(names: list, texts: list[str]) -> pa.RecordBatch:
    """One row for every text but the last, each against the text behind it."""
    n = len(texts) - 1
    cut, edited, lost, gained = [], [], [], []
    for mine, following in zip(texts, texts[1:]):
        m = len(mine) // 4
        keep = mine[: len(mine) - m]
        new = keep + following[:m]
        at = keep.rfind("\n") + 1
        edited.append(new)
        cut.append(at)
        # Without a line end in front, the whole text changes; the sums take care of empty ones.
        lost.append(mine[at:].encode().split(b"\n") if at else paragraphs_of(mine))
        gained.append(new[at:].encode().split(b"\n") if at else paragraphs_of(new))
    equal, like = sums_of([paragraphs_of(t) for t in texts])
    old = sums_of(lost)
    fresh = sums_of(gained)
    mine, after = (equal[:n], like[:n]), (equal[1:], like[1:])
    changed_sums = (mine[0] - old[0] + fresh[0], mine[1] - old[1] + fresh[1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names[:n], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(packed(*mine), pa.string()),
            pa.array(packed(*changed_sums), pa.string()),
            pa.array(likeness(mine, changed_sums), pa.float64()),
            pa.array(likeness(mine, after), pa.float64()),
        ],
        names=[f.split()[0] for f in _OUT.split(", ")],
    )


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_documents(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text replaces the last quarter of the code points by as many (or all) of the
    first of the next document in ascending ``id``; the last one is followed by the first.
    Ids are whole numbers. Null ids come last, rows with equal ids go by text; a single row
    follows itself. A null text is empty: no paragraphs, a zero sum, likeness 1 to another
    empty text and 0 to others. Texts of one to three characters are their own edited texts. Very long
    texts are hashed in pieces of a megabyte. No rows give no rows; other columns are dropped.

    Documents are shuffled once, by ranges of ids of about equal numbers; each range also gets
    the first document of the next one, and a task holds one batch and one text at a time.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    shares = [i / width for i in range(1, width)]
    found, totals = quantiles(
        rows,
        {"id": F.col("id")},
        {"id": shares},
        {"n": F.count(F.lit(1)), "bytes": F.sum(F.octet_length("text").cast("long"))},
        size_for(width),
    )
    edges, pieces = sorted({float(e) for e in found["id"]}), -(-totals["bytes"] // RANGE_BYTES)
    if pieces > width:
        shares = [i / pieces for i in range(1, pieces)]
        again, _ = quantiles(rows, {"id": F.col("id")}, {"id": shares}, {}, size_for(pieces))
        edges = sorted({float(e) for e in again["id"]})
    ranged = with_bucket(rows, "id", edges, "range")
    # One row per range reaches the driver: its first id, or null where it holds only null ids.
    firsts = sorted(
        (r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.min("id").alias("first")).collect()
    )
    if not firsts:
        return spark.createDataFrame([], _OUT)
    before = [firsts[-1][0], *[r for r, _ in firsts[:-1]]]
    leads = spark.createDataFrame(
        [(r, i, b) for (r, i), b in zip(firsts, before)], "lead_range int, lead_id long, before int"
    )
    # As many rows as ranges, so they are sent to the documents.
    leading = (F.col("range") == F.col("lead_range")) & F.col("id").eqNullSafe(F.col("lead_id"))
    heads = ranged.join(F.broadcast(leads), leading).groupBy("range").agg(
        F.min("text").alias("text"), F.min("id").alias("id"), F.min("before").alias("before")
    )
    heads = heads.select("id", "text", F.col("before").alias("range"), F.lit(True).alias("head"))
    both = ranged.withColumn("head", F.lit(False)).unionByName(heads)
    count = len(edges) + 3
    placed = both.repartitionById(count, F.col("range").cast("int")).sortWithinPartitions(
        "range", "head", F.col("id").asc_nulls_last(), "text"
    )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, held = [], [], 0
        for batch in batches:
            for i, value, head in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["head"].to_pylist()):
                names.append(i)
                texts.append(value)
                held += len(value)
                if len(texts) > 1 and (head or held >= CHUNK):
                    yield _compared(names, texts)
                    names, texts, held = names[-1:], texts[-1:], len(value)
                if head:
                    names, texts, held = [], [], 0

    return placed.select("id", "text", "head").mapInArrow(follow, _OUT)

