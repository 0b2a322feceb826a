"""Cheapest repair of conversations to the turn grammar ``(s?(ua)+)?``.

The grammar over role initials has four stack tops: nothing yet, after a system turn, after a
user turn, after an assistant turn. A conversation is read from its end, so that the best
continuation of every stack top is known when a row is added; stacks with equal tops are merged
by the least (cost, audit). Merged candidates differ in their first edit, so one comparison
decides, and a stack keeps one pointer per top and row.

Conversations of bounded size are repaired whole. Longer ones are cut into chunks: each chunk is
first reduced to the least costs from top to top, the chunks' costs are chained, and then all
chunks are repaired on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tallyguard.llm.common import sent_if_few, written
from tallyguard.session import partition_target

#: Rows and bytes of a conversation, or of a chunk of a longer one, that a task holds.
CHUNK_ROWS, CHUNK_BYTES = 4_096, 1 << 20
#: Conversations or chunks turned into Python values at once.
MAPPED_ROWS = 16

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NEVER = 1 << 60
#: Where each stack top goes with a user or assistant turn, and with a system turn.
_NEXT, _SYSTEM = (2, 2, 3, 2), {0: 1}
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_ENDS = (0, NEVER, NEVER, 0)

_EDIT = pa.list_(
    pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
)
_RECORD = pa.schema(
    [
        *((n, pa.int64()) for n in ("conv_id", "number", "chunk", "first_turn", "last_turn", "n_turns")),
        *((n, pa.string()) for n in ("first_initial", "last_initial")),
        *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()),
        ("edits", _EDIT),
    ]
)
_DIGEST = pa.schema(
    [
        *((n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
    ]
)
_TURN = [("turn", pa.int64()), *((n, pa.string()) for n in ("role", "key", "text", "fault"))]
_READY = pa.schema([*((n, pa.int64()) for n in ("conv_id", "number", "chunk")), ("rows", pa.list_(pa.struct(_TURN)))])
_NUMBERED = pa.schema([("number", pa.int64()), ("chunk", pa.int64()), ("values", pa.list_(pa.int64()))])


def fault_of_text(text: Column) -> Column:
    """``blank``, ``truncated`` or null, by the text alone. White space is ASCII's."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(
        ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"
    )


def _inserted(costs: Sequence[int], edits: Sequence[str]) -> tuple[list[int], list[str]]:
    """Least costs per stack top where turns may be inserted in front of what follows."""
    two, three = costs[2], costs[3]
    after = (min(two, INSERT + three), min(three, INSERT + two))
    through = (INSERT + after[0], INSERT + after[0], INSERT + three, INSERT + two)
    best = [min((costs[top], edits[top]), (through[top], "I")) for top in range(4)]
    return [c for c, _ in best], [e for _, e in best]


def read_backwards(
    turns: Sequence[tuple[str, str | None]], after: Sequence[int]
) -> tuple[list[int], list[list[str]]]:
    """Merge the stacks of (initial, fault) rows from the last to the first.

    ``after`` has the least cost of what follows per stack top. Gives the costs in front of the
    rows, and per row, and behind the last one, the edit that each stack top continues with.
    An empty edit behind the last row leaves the choice to what follows.
    """
    costs, edits = _inserted(list(after), [""] * 4)
    pointers = [edits]
    for initial, fault in reversed(turns):
        gone = fault == "blank" or fault == "duplicate"
        extra = CUT_OFF if fault == "truncated" else 0
        best = []
        for top in range(4):
            choice = (DELETE + costs[top], "D")
            if not gone:
                ahead = _NEXT[top]
                if initial == ("a" if ahead == 3 else "u"):
                    choice = min(choice, (extra + costs[ahead], "K"))
                else:
                    choice = min(choice, (REROLE + extra + costs[ahead], "R"))
                    if initial == "s" and top in _SYSTEM:
                        choice = min(choice, (extra + costs[_SYSTEM[top]], "K"))
            best.append(choice)
        costs, edits = _inserted([c for c, _ in best], [e for _, e in best])
        pointers.append(edits)
    pointers.reverse()
    return costs, pointers


def walk(rows: Sequence[dict], pointers: Sequence[Sequence[str]], top: int) -> tuple[list[tuple], int]:
    """Edits (edit, turn, role, text) from a stack top on, and the top behind the rows."""
    out = []
    for i in range(len(rows) + 1):
        while pointers[i][top] == "I":
            top = _NEXT[top]
            out.append(("I", None, _ROLE[top], ""))
        if i == len(rows):
            break
        row, edit = rows[i], pointers[i][top]
        role = row["role"]
        if edit == "K":
            top = 1 if role[:1] == "s" else _NEXT[top]
        elif edit == "R":
            top = _NEXT[top]
            role = _ROLE[top]
        out.append((edit, row["turn"], role, row["text"]))
    return out, top


def _faults(rows: Sequence[dict]) -> list[str | None]:
    """First fault of each row, repeats within ``rows`` included."""
    seen, out = set(), []
    for row in rows:
        key = (row["role"], row["text"])
        out.append("duplicate" if row["fault"] != "blank" and key in seen else row["fault"])
        seen.add(key)
    return out


def _shape(rows: Sequence[dict], faults: Sequence[str | None]) -> tuple:
    """What a chunk adds to the counts of its conversation."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    counts = [sum(f == name for f in faults) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))
    ends = (turns[0], turns[-1]) if turns else (None, None)
    heads = (initials[0], initials[-1]) if initials else (None, None)
    return *ends, len(set(turns)), *heads, *counts, illegal


def _record(rows, faults, after, top, conv_id, number=0, chunk=0) -> tuple:
    turns = [(r["role"][:1], f) for r, f in zip(rows, faults)]
    costs, pointers = read_backwards(turns, after)
    edits, last = walk(rows, pointers, top)
    return (
        conv_id,
        number,
        chunk,
        *_shape(rows, faults),
        costs[top] - after[last],
        "".join(e[0] for e in edits),
        [dict(zip(("edit", "turn", "role", "text"), e)) for e in edits],
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _mapped(df: DataFrame, function, schema: pa.Schema) -> DataFrame:
    """``function`` gives the output tuples of one row (a dict)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), MAPPED_ROWS):
                rows = batch.slice(i, MAPPED_ROWS).to_pylist()
                yield _batch([out for row in rows for out in function(row)], schema)

    return df.mapInArrow(apply, from_arrow_schema(schema))


def _streamed(df: DataFrame, start, step, schema: pa.Schema) -> DataFrame:
    """Fold sorted rows per ``number``: ``step(state, row)`` gives the next state and tuples.

    A row of None ends a conversation. The state is all that is held between rows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, state, begun = None, None, False
        for batch in batches:
            for i in range(len(batch)):
                row, out = batch.slice(i, 1).to_pylist()[0], []
                if not begun or row["number"] != number:
                    if begun:
                        out += step(state, None)[1]
                    number, state, begun = row["number"], start(), True
                state, more = step(state, row)
                if out + more:
                    yield _batch(out + more, schema)
        if begun:
            yield _batch(step(state, None)[1], schema)

    return df.mapInArrow(apply, from_arrow_schema(schema))


@dataclass
class Repaired:
    """Repaired conversations: one row each in ``whole``, one row per chunk in ``pieces``.

    Columns: conv_id, chunk (ascending), first_turn, last_turn, n_turns (distinct),
    first_initial, last_initial, blank, duplicate, truncated, illegal, cost, audit and edits
    (edit, turn, role, text) in order, deleted turns included. ``pieces`` is None if no
    conversation had to be cut.
    """

    whole: DataFrame
    pieces: DataFrame | None


def repair_conversations(
    df: DataFrame,
    id: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
) -> Repaired:
    """Cheapest edits that give each conversation the roles ``(s?(ua)+)?``; ties ASCII-least.

    Keeping a turn costs 0, another role 3, deleting 4, inserting an empty turn 3, and a
    truncated turn that stays 3 more; blank and duplicate turns must go.

    Turns go by ``order``, nulls first, then by role, then by the SHA-256 of the text. A null
    role or text is one space: such a text is blank. Null ids are one conversation. Only rows
    with ``present`` count (by default all), yet every id gives a row, with zeros, an empty
    audit and no edits if it has none. Repeated rows are duplicates. Ids and turns are whole
    numbers; other columns are dropped, whatever their names. An empty table gives no rows.

    Conversations over ``chunk_rows`` rows or ``chunk_bytes`` bytes, such as one that holds a
    third of all rows, are cut into chunks that are repaired in parallel; a very long text is a
    chunk of its own.
    """
    space = F.lit(" ")
    rows = df.select(
        F.col(id).cast("long").alias("conv_id"),
        F.col(order).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    sizes = rows.groupBy("conv_id").agg(
        F.count_if(F.col("present")).alias("n"),
        F.sum(F.when(F.col("present"), F.octet_length("text")).otherwise(0)).alias("bytes"),
    )
    long = written(sizes.where((F.col("n") > chunk_rows) | (F.col("bytes") > chunk_bytes)))
    row = F.struct("turn", "role", F.sha2("text", 256).alias("key"), "text", fault_of_text(F.col("text")).alias("fault"))
    if not long.limit(1).count():
        return Repaired(_whole(rows, row), None)
    long = written(
        long.select(F.col("conv_id").alias("long_id"), "n", F.monotonically_increasing_id().alias("number"))
    )
    sent = sent_if_few(long)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    cut = rows.join(sent, same).where("present").select("conv_id", "number", row.alias("row"))
    width = partition_target(df.sparkSession, long.agg(F.sum("n")).first()[0])
    pieces = _pieces(cut, width, chunk_rows, chunk_bytes)
    return Repaired(_whole(rows.join(sent, same, "left_anti"), row), pieces)


def _whole(rows: DataFrame, row: Column) -> DataFrame:
    listed = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("present"), row))).alias("rows")
    )

    def repair(found: dict) -> list[tuple]:
        turns = found["rows"]
        return [_record(turns, _faults(turns), _ENDS, 0, found["conv_id"])]

    return _mapped(listed, repair, _RECORD)


def _chunks(rows: DataFrame, width: int, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Rows in order, gathered to chunks whose numbers ascend with the order."""
    # Range edges are sampled, so the rows and their numbers are made durable first.
    numbered = written(rows.select("*", F.monotonically_increasing_id().alias("at")))
    keys = ["number", F.col("row.turn").asc_nulls_first(), "row.role", "row.key", "at"]
    dealt = numbered.repartitionByRange(width, *keys).sortWithinPartitions(*keys)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        last, held, size = None, [], 0
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1).to_pylist()[0]
                mine = (one["conv_id"], one["number"])
                if held and (len(held) == chunk_rows or size > chunk_bytes or mine != last):
                    yield _batch([(*last, at, held)], _READY)
                    at, held, size = at + 1, [], 0
                last = mine
                held.append(one["row"])
                size += len(one["row"]["text"])
        if held:
            yield _batch([(*last, at, held)], _READY)

    return written(dealt.select("conv_id", "number", "row").mapInArrow(gather, from_arrow_schema(_READY)))


def _with_faults(chunks: DataFrame) -> DataFrame:
    """The chunks with each row's first fault, repeats of earlier chunks included."""
    apart = chunks.select("number", "chunk", F.posexplode("rows").alias("place", "row"))
    same = [F.col("row.role").alias("role"), F.col("row.key").alias("key")]
    firsts = apart.groupBy("number", "chunk", *same).agg(F.min("place").alias("place"))
    least = firsts.groupBy("number", "role", "key").agg(F.min("chunk").alias("least"))
    again = firsts.join(least, ["number", "role", "key"]).where("chunk > least")
    again = again.groupBy("number", "chunk").agg(F.collect_list("place").alias("again"))

    def judge(found: dict) -> list[tuple]:
        turns, repeated = found["rows"], set(found["again"] or ())
        for i, (turn, fault) in enumerate(zip(turns, _faults(turns))):
            turn["fault"] = "duplicate" if i in repeated and fault != "blank" else fault
        return [(found["conv_id"], found["number"], found["chunk"], turns)]

    return written(_mapped(chunks.join(again, ["number", "chunk"], "left"), judge, _READY))


def _pieces(rows: DataFrame, width: int, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Chunks, their costs from top to top, the costs chained, then each chunk repaired."""
    ready = _with_faults(_chunks(rows, width, chunk_rows, chunk_bytes))
    initial = F.transform("rows", lambda r: F.struct(F.substring(r["role"], 1, 1).alias("i"), r["fault"].alias("f")))
    lean = ready.select("number", "chunk", initial.alias("turns"))
    fields = ["number", "chunk", "values"]

    def reduce(found: dict) -> list[tuple]:
        turns = [(t["i"], t["f"]) for t in found["turns"]]
        ways = [read_backwards(turns, [0 if i == end else NEVER for i in range(4)])[0] for end in range(4)]
        return [(found["number"], found["chunk"], [ways[end][top] for top in range(4) for end in range(4)])]

    def chain(after: list[int], row: dict | None) -> tuple:
        if row is None:
            return after, []
        v = row["values"]
        front = [min(v[4 * top + end] + after[end] for end in range(4)) for top in range(4)]
        return [min(c, NEVER) for c in front], [(row["number"], row["chunk"], list(after))]

    costs = _mapped(lean, reduce, _NUMBERED).repartition("number").sortWithinPartitions("number", F.desc("chunk"))
    after = written(_streamed(costs, lambda: list(_ENDS), chain, _NUMBERED))

    def exits(found: dict) -> list[tuple]:
        _, pointers = read_backwards([(t["i"], t["f"]) for t in found["turns"]], found["values"])
        bare = [{"turn": None, "role": t["i"], "text": ""} for t in found["turns"]]
        return [(found["number"], found["chunk"], [walk(bare, pointers, top)[1] for top in range(4)])]

    def enter(top: int, row: dict | None) -> tuple:
        return (top, []) if row is None else (row["values"][top], [(row["number"], row["chunk"], [top])])

    left = _mapped(lean.join(after, ["number", "chunk"]), exits, _NUMBERED)
    left = left.repartition("number").sortWithinPartitions("number", "chunk")
    tops = written(_streamed(left, int, enter, _NUMBERED)).select("number", "chunk", F.col("values").alias("entered"))

    def repair(found: dict) -> list[tuple]:
        turns = found["rows"]
        faults = [r["fault"] for r in turns]
        names = [found[k] for k in ("conv_id", "number", "chunk")]
        return [_record(turns, faults, found["values"], found["entered"][0], *names)]

    states = after.select(*fields).join(tops, ["number", "chunk"])
    return _mapped(ready.join(states, ["number", "chunk"]), repair, _RECORD)


_COUNTED = ("blank", "duplicate", "truncated", "illegal", "cost")


def digest_conversations(repaired: Repaired) -> DataFrame:
    """One row per conversation: counts, cost, audit, and the SHA-256 of the repaired turns.

    The hash runs over ``role:text`` lines joined by newlines; without lines it is that of the
    empty string. A hash of a text is sequential, so the chunks of a cut conversation pass
    through one task in order, one chunk at a time.
    """
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    lines = F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = repaired.whole.select(
        "conv_id",
        gaps.alias("gaps"),
        *_COUNTED,
        "audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )
    if repaired.pieces is None:
        return whole

    def start() -> dict:
        empty = {"first": None, "last": None, "turns": 0, "initial": None, "audit": [], "lines": 0}
        return empty | {"hash": hashlib.sha256(), "sums": [0] * len(_COUNTED)}

    def add(state: dict, row: dict | None) -> tuple:
        if row is None:
            span = 0 if state["first"] is None else state["last"] - state["first"] + 1 - state["turns"]
            return state, [
                (state["conv_id"], span, *state["sums"], "".join(state["audit"]), state["hash"].hexdigest())
            ]
        state["conv_id"] = row["conv_id"]
        sums = [a + row[c] for a, c in zip(state["sums"], _COUNTED)]
        if state["initial"] is not None and (state["initial"], row["first_initial"]) not in _LEGAL:
            sums[_COUNTED.index("illegal")] += 1
        state["sums"], state["initial"] = sums, row["last_initial"]
        if row["first_turn"] is not None:
            state["turns"] += row["n_turns"] - (state["last"] == row["first_turn"])
            state["first"] = row["first_turn"] if state["first"] is None else state["first"]
            state["last"] = row["last_turn"]
        state["audit"].append(row["audit"])
        for edit in row["edits"]:
            if edit["edit"] != "D":
                line = f"{edit['role']}:{edit['text']}".encode()
                state["hash"].update(b"\n" + line if state["lines"] else line)
                state["lines"] += 1
        return state, []

    pieces = repaired.pieces.repartition("number").sortWithinPartitions("number", "chunk")
    return whole.unionByName(_streamed(pieces, start, add, _DIGEST))


def damaged(df: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults put in by a checksum of ``conv_id:turn``, and which rows stay.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats
    it, 4 makes it a user turn. Nulls are one space, in the checksum as in role and text.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.coalesce(F.col("text"), space)
    rows = df.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(kind, kind)).otherwise(F.array(kind))).alias("kind"),
    )
    return rows, F.col("kind") != 0
