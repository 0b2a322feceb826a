"""What each filter of a chain removes, for every order of the filters.

Each filter keeps, per part and id range, the sorted list of the ids that fail it. What a filter
removes after others is the difference of its list and the union of theirs. Unions and
differences are galloping merges within a range, and only their sizes leave the task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.common import free_name, written
from tallyguard.llm.galloping import difference, shared, union

#: Rows of an id range: the longest list that a task holds.
RANGE_ROWS = 65_536
#: Parts whose sums a task holds before it passes them on.
HELD_PARTS = 2_000
#: Subsets and orders double and multiply with each filter.
MOST_FILTERS = 7


def repeats_smaller_id(df: DataFrame, id: str, text: str, name: str) -> DataFrame:
    """Adds the boolean ``name``: a row with a smaller id has the same text (null: empty).

    A null id is smaller than none and larger than none, so its row does not repeat. Rows with
    the same id do not make each other repeat. Texts are compared by SHA-256. A text that holds
    most rows is one row per task in the shuffle; the join runs on the id.
    """
    key, first, other = (free_name(df, n) for n in ("_text_key", "_first_id", "_other_key"))
    keyed = df.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    firsts = (
        keyed.where(F.col(id).isNotNull())
        .groupBy(F.col(key).alias(other))
        .agg(F.min(id).alias(first))
    )
    joined = keyed.join(firsts, (F.col(id) == F.col(first)) & (F.col(key) == F.col(other)), "left")
    return joined.withColumn(name, F.col(id).isNotNull() & F.col(first).isNull()).drop(key, first, other)


def posting_lists(marked: DataFrame, part: str, fails: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """(part, first, n, failing, flagged) per part and id range, ids counted within the tasks.

    ``failing`` holds one sorted id list per column of ``fails``, ``flagged`` one per column of
    ``flags``. A row's id is its place in its task, so that any id column, also one with nulls
    or repeats, gives lists without repeats. A range has at most RANGE_ROWS rows.
    """
    columns = [*fails, *flags]
    bits = sum(
        (F.coalesce(F.col(c), F.lit(False)).cast("long") * (1 << i) for i, c in enumerate(columns)),
        F.lit(0).cast("long"),
    )
    rows = marked.select(F.coalesce(F.col(part), F.lit("")).alias("part"), bits.alias("bits"))
    n_fails, n_all = len(fails), len(columns)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, names, masks, held = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            part_of = pa.concat_arrays(names).dictionary_encode()
            codes, bit = part_of.indices.to_numpy(), np.concatenate(masks)
            out = {"part": [], "first": [], "n": [], "failing": [], "flagged": []}
            for code, value in enumerate(part_of.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code) if len(part_of.dictionary) > 1 else np.arange(len(bit))
                mine = bit[at]
                lists = [(at[(mine >> i) & 1 == 1] + first).tolist() for i in range(n_all)]
                for k, v in zip(out, (value, first, len(at), lists[:n_fails], lists[n_fails:])):
                    out[k].append(v)
            return pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], f.type) for f in _LISTS], schema=_LISTS
            )

        for batch in batches:
            at = 0
            while at < len(batch):
                piece = batch.slice(at, RANGE_ROWS - held)
                names.append(piece.column(0))
                masks.append(piece.column(1).to_numpy())
                held, at = held + len(piece), at + len(piece)
                if held == RANGE_ROWS:
                    yield flush()
                    first, names, masks, held = first + held, [], [], 0
        if held:
            yield flush()

    return rows.mapInArrow(listed, "part string, first long, n long, failing array<array<long>>, flagged array<array<long>>")


_IDS = pa.list_(pa.list_(pa.int64()))
_LISTS = pa.schema(
    [("part", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("failing", _IDS), ("flagged", _IDS)]
)


def _subsets(n: int) -> list[int]:
    return list(range(1 << n))


def _keys(n_fails: int, n_flags: int) -> dict[tuple, int]:
    """Places of the sums of a part: rows, sizes of unions, sizes of differences."""
    keys = [("rows",), *(("union", s) for s in _subsets(n_fails))]
    for s in _subsets(n_fails):
        for f in range(n_fails):
            if not s >> f & 1:
                keys += [("removed", s, f), *(("lost", s, f, g) for g in range(n_flags))]
    return {k: i for i, k in enumerate(keys)}


def removal_sizes(lists: DataFrame, n_fails: int, n_flags: int) -> DataFrame:
    """(part, sizes): sums over the id ranges of rows, unions and differences, by ``_keys``."""
    keys = _keys(n_fails, n_flags)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(p, k, v) for p, a in sums.items() for k, v in enumerate(a.tolist()) if v]
            sums.clear()
            cells = list(zip(*rows)) or [[], [], []]
            types = (pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cells, types)], names=["part", "key", "value"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                total = sums.setdefault(row["part"], np.zeros(len(keys), "int64"))
                failing, flagged = row["failing"], row["flagged"]
                total[keys["rows",]] += row["n"]
                for s in _subsets(n_fails):
                    before = union([failing[i] for i in range(n_fails) if s >> i & 1])
                    total[keys["union", s]] += len(before)
                    for f in range(n_fails):
                        if s >> f & 1:
                            continue
                        removed = difference(failing[f], before)
                        total[keys["removed", s, f]] += len(removed)
                        for g in range(n_flags):
                            total[keys["lost", s, f, g]] += len(shared(removed, flagged[g]))
                if len(sums) >= HELD_PARTS:
                    yield flush()
        if sums:
            yield flush()

    cells = lists.mapInArrow(merged, "part string, key int, value long")
    added = cells.groupBy("part", "key").agg(F.sum("value").alias("value"))
    return added.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("sizes")
    )


def audit_filters(
    df: DataFrame,
    fails: Mapping[str, str],
    part: str,
    flags: Mapping[str, str] | None = None,
    orders: Sequence[str] | None = None,
) -> DataFrame:
    """One row per part, filter order and step, zeros included.

    ``fails`` maps one-letter filter names to boolean columns that are true where a row fails;
    ``flags`` maps output names to boolean columns to count among the removed rows. ``orders``
    are strings of letters, by default all permutations. A null fails nothing and has no flag;
    a null part is the empty string, together with the parts that are empty strings.

    Columns: part, filter_order, step (from 1), kept (after the step), removed (at the step),
    redundant (failing, but removed earlier), unique_fails (failing this filter alone), one
    count per flag, shapley (the filter's removed, summed over all permutations). An empty
    table has no parts and gives no rows. Repeated rows count each. No text is read here.
    """
    letters, flags = list(fails), dict(flags or {})
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter are needed")
    orders = ["".join(p) for p in permutations(letters)] if orders is None else list(orders)
    if any(len(set(o)) != len(o) or not set(o) <= set(letters) for o in orders):
        raise ValueError("an order names a filter twice, or one that is unknown")

    keys = _keys(n, len(flags))
    lists = posting_lists(df, part, list(fails.values()), list(flags.values()))
    sizes = removal_sizes(lists, n, len(flags))
    at = {x: i for i, x in enumerate(letters)}
    steps = []
    for order in orders:
        before = 0
        for step, letter in enumerate(order, 1):
            f, everything = at[letter], (1 << n) - 1
            places = [keys["union", before | 1 << f], keys["removed", before, f], keys["removed", 0, f]]
            places += [keys["removed", everything & ~(1 << f), f]]
            places += [keys["lost", before, f, g] for g in range(len(flags))]
            steps.append((order, step, letter, places))
            before |= 1 << f
    # One row per order and step, whatever the data; beside each part's few hundred sums.
    names = ("filter_order", "step", "letter", "places")
    fields = "array<struct<filter_order:string,step:int,letter:string,places:array<int>>>"
    plan = F.from_json(F.lit(json.dumps([dict(zip(names, s)) for s in steps])), fields)

    def sized(place: Column) -> Column:
        return F.coalesce(F.element_at("sizes", place), F.lit(0)).cast("long")

    def place(i: int) -> Column:
        return F.element_at("places", F.lit(i + 1))

    rows = sizes.select("part", "sizes", F.inline(plan))
    shapley = F.lit(0).cast("long")
    for letter in letters:
        others = [i for i in range(n) if i != at[letter]]
        value = F.lit(0).cast("long")
        for size in range(n):
            for chosen in combinations(others, size):
                s = sum(1 << i for i in chosen)
                weight = factorial(size) * factorial(n - 1 - size)
                value = value + sized(F.lit(keys["removed", s, at[letter]])) * weight
        shapley = F.when(F.col("letter") == letter, value).otherwise(shapley)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (sized(F.lit(keys["rows",])) - sized(place(0))).alias("kept"),
        sized(place(1)).alias("removed"),
        (sized(place(2)) - sized(place(1))).alias("redundant"),
        sized(place(3)).alias("unique_fails"),
        *[sized(place(4 + g)).alias(name) for g, name in enumerate(flags)],
        shapley.alias("shapley"),
    )


def failing_columns(text: Column) -> dict[str, Column]:
    """The four filters that look at one text alone (null: empty), true where it fails.

    A: under 200 words. B: under half of the words are distinct. C: over 3 % capital letters
    A-Z. D: holds any of ``#$%&*|``. Words are runs without ASCII white space.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals > 3 * F.length(whole),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over documents, A to D as above and E for repeated texts.

    E fails where a smaller doc_id has the same text. ``good_lost`` and ``toxic_lost`` count
    removed documents with a label row of quality 1 or toxic 1; unlabelled documents count as
    neither. Null texts are empty, null ids have no labels and do not repeat. Texts are read
    whole, at any length, in one pass that leaves a few dozen bytes per document.
    """
    four = failing_columns(F.col("text"))
    key = F.coalesce(F.col("text"), F.lit(""))
    narrow = written(
        documents.select("doc_id", "lang", F.sha2(key, 256).alias("text"), *[c.alias(k) for k, c in four.items()])
    )
    marked = repeats_smaller_id(narrow, "doc_id", "text", "E")
    # Rows without an id find no label; their texts spread them over the tasks of the join.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    same = (F.col("doc_id") == F.col("label_id")) & (spread == F.lit(0))
    flagged = marked.join(known.hint("merge"), same, "left")
    return audit_filters(flagged, {x: x for x in "ABCDE"}, "lang", {"good_lost": "good", "toxic_lost": "toxic"})
