"""Token counts and ids of whole texts, by a public tokenizer, in Arrow batches.

A text is cut at safe boundaries: between a character that is no white space and one of the
four plain white-space characters, and between a word of Latin letters and the ASCII sign or
digit that follows it. No pre-token of the supported tokenizers crosses such a place, none of
their special strings is cut by it, and Unicode composition stops there; so the pieces' tokens,
joined, are the text's tokens. Texts with any other white space are encoded whole. Pieces
repeat a lot, so the distinct ones of a batch of texts are looked up in a bounded table of those
that the worker has seen lately, the others are encoded in calls of about equal size, and Arrow
puts the ids of all pieces together.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.common import free_name

#: Characters per call of the tokenizer, and pieces in each of a worker's two tables.
CALL_SIZE = 1 << 18
KEPT_PIECES = 500_000
#: Characters of a piece that is worth keeping.
KEPT_LENGTH = 64

# Every white-space character but the four plain ones.
_ODD_SPACE = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Kinds of bytes: signs and digits, plain white space, Latin letters, the rest.
_SIGN, _SPACE, _LETTER, _REST = range(4)
_KIND = np.full(256, _REST, np.uint8)
_KIND[:128] = [_SPACE if c in b" \t\n\r" else _LETTER if chr(c).isalpha() else _SIGN for c in range(128)]
#: A word that may stand between others, and how many of them are encoded as one string.
_WORD = re.compile(r"[ \n][A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
WORDS = 128
#: Normalizers that keep the number of bytes of every such word, but for its white space.
_KEEPS_SIZE = (
    {"type": "NFC"},
    {"type": "Lowercase"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
)


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start, which lie in ``data`` as UTF-8 bytes one after another;
    ``begins`` is where each text does. None of them has white space but the four plain ones.

    White space and what follows it is a piece. Is this a word of Latin letters after at most one
    space or line feed, then the sign or digit behind it starts another piece.
    """
    size = len(data)
    kind = _KIND[data]
    # Latin letters of two bytes, without the signs for times and divided by.
    wide = np.flatnonzero(data == 0xC3)
    wide = wide[(data[wide + 1] & 0xDF) != 0x97]
    kind[wide] = kind[wide + 1] = _LETTER
    first = np.zeros(size + 1, bool)
    first[begins] = first[size] = True
    space, letter = kind == _SPACE, np.zeros(size + 1, bool)
    letter[:size] = kind == _LETTER
    starts = first[:size].copy()
    starts[1:] |= space[1:] & ~space[:-1]
    before = np.concatenate([[False], letter[:-1]]) & ~first
    word = np.flatnonzero(letter & ~before)
    end = np.flatnonzero(np.concatenate([[False], letter[:-1]]) & (~letter | first))
    led = np.maximum(word - 1, 0)
    alone = first[word] | starts[led] & ((data[led] == 0x20) | (data[led] == 0x0A))
    end = end[alone & ~first[end]]
    starts[end[kind[end] == _SIGN]] = True
    return np.flatnonzero(starts)


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, which joined are the texts, and each text's first piece, with
    the number of all pieces at the end. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, size + 1, 8 * texts.offset)
    held = texts.buffers()[2]
    begin, end = int(offsets[0]), int(offsets[-1])
    if begin == end:
        return pa.array([], pa.large_string()), np.zeros(size + 1, np.int64)
    held, offsets = held.slice(begin, end - begin), offsets - begin
    starts = piece_starts(np.frombuffer(held, np.uint8), offsets)
    odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False))
    if len(odd):
        text = np.searchsorted(offsets, starts, "right") - 1
        starts = starts[~np.isin(text, odd) | (starts == offsets[text])]
    bounds = np.append(starts, end - begin)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), held)
    return pieces, np.searchsorted(bounds, offsets)


class Places(dict):
    """Values by piece; what is not here is taken from ``old``, or is None."""

    old: dict = {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is not None:
            self[piece] = value
        return value


class PieceTable:
    """What a worker knows about pieces: their number of tokens, or their ids."""

    def __init__(self, path: str, value: Callable):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.value = value
        self.known = Places()
        self.old: dict[str, object] = {}
        self.sentences = path.endswith(".model")
        if self.sentences:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
        self.sizes = None if self.sentences else self._token_sizes(path)

    def _token_sizes(self, path: str) -> np.ndarray | None:
        """The bytes of text that each id stands for, if words can be told apart by them."""
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        steps = [
            [] if (s := settings.get(k)) is None else s.get(f"{k}s".replace("_", ""), [s])
            for k in ("normalizer", "pre_tokenizer")
        ]
        if not all(s in _KEEPS_SIZE for s in steps[0]) or settings["model"]["type"] != "BPE":
            return None
        # A character of a token is a byte.
        if not steps[1] or steps[1][-1]["type"] != "ByteLevel" or steps[1][-1]["add_prefix_space"]:
            return None
        end = settings["model"].get("end_of_word_suffix") or ""
        vocabulary = self.model.get_vocab()
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            sizes[i] = len(token.removesuffix(end))
        spaces = {int(sizes[ids].sum()) - 1 for ids in self._ids([" a", "\na", " B", "\nB"])}
        if len(spaces) > 1:
            return None
        (self.space,) = spaces
        return sizes

    def _ids(self, pieces: list[str]) -> Iterator[list[int]]:
        """One list at a time: many at once make Python look for garbage again and again."""
        if self.sentences:
            return iter(self.model.encode(pieces, num_threads=1))
        return (e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False))

    def _word_ids(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of words that start with white space, many to a string, told apart by bytes."""
        groups = [words[a : a + WORDS] for a in range(0, len(words), WORDS)]
        for group, ids in zip(groups, self._ids(["".join(g) for g in groups])):
            ends = np.cumsum([len(w.encode()) for w in group]) - (1 - self.space) * np.arange(1, len(group) + 1)
            sizes = self.sizes[ids]
            reached = np.cumsum(sizes)
            last = np.searchsorted(reached, ends)
            if not len(ids) or not sizes.all() or reached[-1] != ends[-1] or (reached[last] != ends).any():
                yield from self._ids(group)
                continue
            start = 0
            for end in (last + 1).tolist():
                yield ids[start:end]
                start = end

    def _encoded(self, places: list[int], pieces: list[str]) -> Iterator[tuple[int, list[int]]]:
        """These places of ``pieces``, each with the ids of its piece."""
        words = [i for i in places if _WORD(pieces[i])] if self.sizes is not None else []
        rest = [i for i in places if not _WORD(pieces[i])] if words else places
        for some, ids_of in ((words, self._word_ids), (rest, self._ids)):
            start = size = 0
            for n, i in enumerate(some, 1):
                size += len(pieces[i])
                # In calls of about CALL_SIZE characters.
                if size >= CALL_SIZE or n == len(some):
                    part = some[start:n]
                    yield from zip(part, ids_of([pieces[i] for i in part]))
                    start, size = n, 0

    def _turn(self, kept: int) -> None:
        if len(self.known) > kept:
            self.old, self.known = self.known, Places()

    def cut(self, texts: list | pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of all texts, which of them each piece is, and each text's first."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.sentences:
            # White space is part of a sentence model's pieces, so its texts stay whole.
            pieces, firsts = pc.fill_null(texts, ""), np.arange(len(texts) + 1)
        else:
            pieces, firsts = pieces_of(texts)
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        return distinct, pieces.indices.to_numpy(), firsts

    def looked_up(self, pieces: list[str], kept: int | None = None) -> list:
        """The values of distinct pieces."""
        self._turn(kept or KEPT_PIECES)
        known = self.known
        known.old = self.old
        values = list(map(known.__getitem__, pieces))
        known.old = {}
        fresh = [i for i, value in enumerate(values) if value is None]
        for i, ids in self._encoded(fresh, pieces):
            values[i] = value = self.value(ids)
            if len(pieces[i]) <= KEPT_LENGTH:
                known[pieces[i]] = value
        return values

    def joined(self, texts: list | pa.Array, kept: int | None = None) -> list[bytes]:
        """The values of each text's pieces, which are bytes, joined; null has none."""
        pieces, which, firsts = self.cut(texts)
        whole = pa.array(self.looked_up(pieces, kept), pa.large_binary()).take(pa.array(which))
        if not len(whole):
            return [b""] * len(texts)
        ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1)[firsts].tolist()
        held = whole.buffers()[2] or pa.py_buffer(b"")
        return [held[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]

    def added(self, texts: list | pa.Array) -> list[int]:
        """The values of each text's pieces, which are numbers, added up; null has 0."""
        pieces, which, firsts = self.cut(texts)
        values = np.array(self.looked_up(pieces), np.int64)[which]
        return np.diff(np.concatenate([[0], np.cumsum(values)])[firsts]).tolist()


_TABLES: dict[tuple, PieceTable] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def _as_bytes(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


def _table(path: str, value: Callable) -> PieceTable:
    """One table for each tokenizer and worker process."""
    key = (path, value)
    if key not in _TABLES:
        _TABLES[key] = PieceTable(path, value)
    return _TABLES[key]


def forget() -> None:
    """Give back this worker's tables and what Arrow holds for reuse, often more than the tables;
    operators that follow on others call it."""
    _TABLES.clear()
    pa.default_memory_pool().release_unused()
    # Freed memory between pieces in use stays with the process unless the C library trims it.
    if _trim:
        _trim(0)


def balanced(texts: list | pa.Array, most: int = 1 << 22) -> Iterator[list | pa.Array]:
    """Slices of consecutive texts with at most ``most`` characters (bytes, if in an Arrow array),
    or one text."""
    if isinstance(texts, pa.Array):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    else:
        sizes = [len(t or "") for t in texts]
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held > most and i > start:
            yield texts[start:i]
            start, held = i, size
    if start < len(sizes):
        yield texts[start:]


def token_counts(texts: list | pa.Array, path: str) -> list[int]:
    """The number of tokens of each text; null has none."""
    pieces = _table(path, len)
    return [n for part in balanced(texts) for n in pieces.added(part)]


def token_bytes(texts: list | pa.Array, path: str, kept: int | None = None) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers; null has none.

    ``kept`` is the number of pieces in each of the worker's two tables, KEPT_PIECES if not given.
    """
    pieces = _table(path, _as_bytes)
    for part in balanced(texts):
        yield from pieces.joined(part, kept)


def count_tokens(
    df: DataFrame,
    path: str,
    text: str = "text",
    into: str = "n_tokens",
    limit: int = 2048,
) -> DataFrame:
    """``df`` without its text, with ``n_bytes``, ``into`` and ``over_limit`` for every row.

    Counts are what the tokenizer at ``path`` gives for the whole text, without begin, end or
    added special tokens. A null or empty text has 0 bytes and 0 tokens, an empty table gives
    an empty table, repeated rows stay, and columns of ``df`` with the names of new ones are
    replaced. Only lengths leave the workers.
    """
    new = {"n_bytes", into.lower(), "over_limit"}
    rest = [c for c in df.columns if c != text and c.lower() not in new]
    held = free_name(df, "_tokens_text")
    sized = df.select(
        *[F.col(f"`{c}`") for c in rest],
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).cast("string").alias(held),
    )
    schema = sized.drop(held).schema.add(into, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = token_counts(batch.column(held), path)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64())],
                [*batch.schema.names[:-1], into],
            )

    return sized.mapInArrow(count, schema).withColumn("over_limit", F.col(into) > limit)
