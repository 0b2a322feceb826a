"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

Sizes of shingle sets fall into bands, each at most 100 / percent wide. Two linked sets differ
in at most H shingles, H known from the band. The universe of shingles is hashed into U units,
U = H + 1 + E. n0 segments have one unit and are indexed as they are; n1 segments have two
units and are indexed with all their subsets that lack one shingle (two such segments match if
they differ in one shingle). If no segment matched, a pair would differ in n0 + 2 n1 = U > H
places, so linked sets share a signature. Empty segments match by chance: a set leaves up to E
of them out, which the spare units E pay for. A cost estimate from the number and size of the
sets of a band chooses n1 and E.

A set is indexed in its own band and, as a larger partner, in the band below. Sets that share a
signature are first compared with the smallest document of the signature only. Pairs of a
signature that are still in different components afterwards are compared one by one, so no link
that matters for a component is lost, and copies are not expanded into pairs. A pair is first
held against its profiles: shingles counted by hash in a few counters, whose differences sum up
to no more than the sets' true difference. What passes is compared shingle by shingle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.common import free_name, sent_if_few, written
from tallyguard.llm.links import components
from tallyguard.llm.tokens import forget

#: Numbers in a set's profile, and nodes of a signature that meet in one block.
PROFILE = 128
MET = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, cut at ASCII white space."""
    return _WORD.findall(text.encode().translate(_LOWER)) if text else []


def shingles_of(words: list[bytes], size: int) -> set[tuple]:
    """Distinct runs of ``size`` words; fewer words are one shingle, none are none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles; only candidates depend on them."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w) for w in set(words)}
    ids = np.array([known[w] for w in words], np.uint64)
    runs = max(1, len(ids) - size + 1)
    out = np.zeros(runs, np.uint64)
    for j in range(min(size, len(ids))):
        out = _mixed(out + ids[j : j + runs])
    return np.unique(out)


class Plan(NamedTuple):
    """A band of sizes, and how the universe is cut for pairs whose smaller set is in it."""

    low: int
    high: int
    exact: int
    deleted: int
    spare: int


def largest_partner(size: int, percent: int) -> int:
    return size * 100 // percent


def largest_difference(a: int, b: int, percent: int) -> int:
    return (a + b) * (100 - percent) // (100 + percent)


def allocate(low: int, high: int, sets: int, percent: int) -> Plan:
    """The cheapest cut of a band with ``sets`` sets: rows of the index and chance pairs."""
    base = largest_difference(high, largest_partner(high, percent), percent) + 1
    size = (low + high) / 2
    best, plan = math.inf, None
    for spare in range(0, 3 + base // 8):
        units = base + spare
        for deleted in sorted({0, 1, units // 4, units // 2}):
            exact = units - 2 * deleted
            if exact < 0:
                continue
            mean = size / units
            # Empty exact segments; with more than the spare ones, a set is indexed by all.
            empty = exact * math.exp(-mean)
            within, term = 0.0, math.exp(-empty)
            for i in range(spare + 1):
                within += term
                term *= empty / (i + 1)
            near_empty = math.exp(-2 * mean) * (1 + 2 * mean)
            chance = (empty * max(0.0, 1 - within) + deleted * near_empty) * sets / 100
            cost = exact - empty + deleted * (1 + 2 * mean) + chance
            if cost < best:
                best, plan = cost, Plan(low, high, exact, deleted, spare)
    return plan


def bands(largest: int, percent: int) -> list[tuple[int, int]]:
    """[low, high] of each band up to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, largest_partner(low, percent))
        out.append((low, high))
        low = high + 1
    return out


def signatures(hashes: np.ndarray, plan: Plan, band: int) -> np.ndarray:
    """Signatures of one set under one plan."""
    units = plan.exact + 2 * plan.deleted
    unit = (_mixed(hashes ^ np.uint64(band + 1)) % np.uint64(units)).astype(np.int64)
    segments = plan.exact + plan.deleted
    segment = np.where(unit < plan.exact, unit, plan.exact + (unit - plan.exact) // 2)
    value = _mixed(hashes + _M2)
    # Sums of mixed hashes: taking a shingle out is a subtraction.
    order = np.argsort(segment, kind="stable")
    sums = np.zeros(segments, np.uint64)
    counts = np.bincount(segment, minlength=segments)
    here = np.flatnonzero(counts)
    if len(here):
        starts = (np.cumsum(counts) - counts)[here]
        sums[here] = np.add.reduceat(value[order], starts)
    whole = np.arange(segments)
    exact, empty = whole[: plan.exact], counts[: plan.exact] == 0
    if empty.sum() <= plan.spare:
        exact = exact[~empty]
    used = np.concatenate([exact, whole[plan.exact :]])
    names, totals = used, sums[used]
    if plan.deleted:
        single = segment >= plan.exact
        names = np.concatenate([names, segment[single]])
        totals = np.concatenate([totals, sums[segment[single]] - value[single]])
    tag = names.astype(np.uint64) * _M2 + np.uint64(band * int(_M1) % (1 << 64))
    return np.unique(_mixed(totals ^ _mixed(tag)))


def _digests(df: DataFrame, size: int) -> DataFrame:
    """(id, digest, n, profile): of the word sequence and of the shingle set."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            digests, sizes, profiles = [], [], []
            for value in batch.column(1).to_pylist():
                words = words_of(value)
                hashes = shingle_hashes(words, size)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(hashes))
                counts = np.bincount((hashes % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE)
                profiles.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(profiles, pa.binary())],
                ["id", "digest", "n", "profile"],
            )

    return df.mapInArrow(digest, "id long, digest binary, n long, profile binary")


def _picked(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose id is among ``keys`` (or not): sent to all workers if few."""
    return df.join(sent_if_few(keys.select("id").distinct()), "id", how)


def _signature_lists(df: DataFrame, size: int, plans: list[Plan]) -> DataFrame:
    """(node, sigs) of documents (id, text)."""
    lows = np.array([p.low for p in plans])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lists = []
            for value in batch.column(1).to_pylist():
                hashes = shingle_hashes(words_of(value), size)
                if not len(hashes):
                    lists.append(np.zeros(0, np.int64))
                    continue
                band = int(np.searchsorted(lows, len(hashes), "right")) - 1
                mine = [signatures(hashes, plans[b], b) for b in range(max(0, band - 1), band + 1)]
                lists.append(np.concatenate(mine).view(np.int64))
            ends = np.cumsum([0, *map(len, lists)])
            values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                ["node", "sigs"],
            )

    return df.mapInArrow(sign, "node long, sigs array<long>")


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and profiles allow to be linked."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16)
                for i in (4, 5)
            )
            apart = np.abs(a - b).sum(1, dtype=np.int64)
            near = apart <= sizes * (100 - percent) // (100 + percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("profile").alias(f"p_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
    return joined.mapInArrow(near, "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are linked, by their true shingles."""
    pairs = written(_close(pairs, nodes, percent))
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = _picked(texts, ends, "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        last, left = None, set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, left = a, shingles_of(words_of(a), size)
                right = shingles_of(words_of(b), size)
                common = len(left & right)
                keep.append(common > 0 and 100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(check, "a long, b long").distinct()


def link_documents(
    df: DataFrame,
    size: int = 3,
    percent: int = 90,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest key reachable by links).

    Two documents link when 100 * intersection >= percent * union of their distinct ``size``-word
    shingles. A null or empty text, or one without words, has no shingles and links with
    nothing. A row with a null key has no component. Rows that repeat a key are one document
    with several texts. An empty table gives an empty table; other columns are not read.
    """
    documents = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    digests = written(_digests(documents, size))
    sets = digests.where("n > 0 and id is not null")
    # One node for all copies of a word sequence.
    nodes = written(
        sets.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("profile").alias("profile"))
    )
    largest = nodes.agg(F.max("n")).first()[0] or 0
    limits = bands(largest, percent)
    if not limits:
        return digests.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    # One number per band; bands are few, their widths grow geometrically.
    lows = F.array(*[F.lit(low) for low, _ in limits])
    band = F.size(F.filter(lows, lambda low: low <= F.col("n"))) - 1
    counts = dict(nodes.groupBy(band.alias("band")).count().collect())
    plans = [allocate(low, high, counts.get(i, 0), percent) for i, (low, high) in enumerate(limits)]
    spare = digests.select("id").where("id is not null").join(nodes.select(F.col("node").alias("id")), "id", "left_anti")
    alone = _picked(documents.where("id is not null and text is not null"), spare, "left_anti")
    index = _signature_lists(alone, size, plans).select("node", F.explode("sigs").alias("sig"))
    # The smallest node of each signature, without gathering the signature's nodes.
    order = Window.partitionBy("sig").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    stars = index.withColumn("a", F.min("node").over(order)).where("node > a")
    stars = written(stars.select("sig", "a", F.col("node").alias("b")))
    pairs = written(stars.select("a", "b").distinct())
    links = written(_verified(pairs, nodes, documents, size, percent))
    found = components(links)
    rest = _open_pairs(stars, found, pairs, nodes, percent)
    more = written(_verified(rest, nodes, documents, size, percent))
    if more.limit(1).count():
        found = components(links.unionByName(more))
    labelled = (
        digests.join(nodes.select("digest", "node"), "digest", "left")
        .join(found, "node", "left")
        .select("id", F.col("n").alias("n_shingles"), "node", "component")
    )
    # A key with several texts belongs to the smallest component of any of them.
    return labelled.select(
        F.col("id").alias(key),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component_id"),
    )


def arrays_of(column: pa.ListArray) -> list[np.ndarray]:
    """Each list of numbers, copied out of its batch."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b].copy() for a, b in zip(ends[:-1], ends[1:])]


def first_shared(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The smallest number that each sorted list of ``others`` shares with ``mine``."""
    if not others:
        return np.zeros(0, np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    starts = np.cumsum([0, *[len(o) for o in others[:-1]]])
    return np.minimum.reduceat(np.where(mine[at] == flat, flat, np.iinfo(np.int64).max), starts)


def _open_pairs(stars: DataFrame, found: DataFrame, done: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one signature in different components that were not compared yet and that
    sizes and profiles allow. A signature's nodes are dealt by hash into blocks of about MET
    nodes, any two of which meet in one task, and only pairs that pass leave it."""
    label = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    named = stars.join(label("b"), "b", "left").withColumn("c_b", F.coalesce("c_b", "b"))
    # A signature is open if two of its nodes other than the smallest are in two components.
    open_ = (
        named.groupBy("sig")
        .agg(F.min("c_b").alias("low"), F.max("c_b").alias("high"), F.count(F.lit(1)).alias("m"))
        .where("low < high")
        .select("sig", F.ceil(F.col("m") / MET).cast("int").alias("blocks"))
    )
    shared = written(named.join(open_, "sig").select("sig", "blocks", F.col("b").alias("node"), F.col("c_b").alias("c")))
    # A pair meets in every signature it shares, and leaves only from the smallest of them.
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
    members = (
        shared.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "c")
        .join(nodes.select("node", "n", "profile"), "node")
        .join(lists, "node")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple] = []

        def passed(rows: list[tuple]) -> pa.RecordBatch:
            sig, i, j, mine, node, c, n, profile, sigs = zip(*rows)
            block, node, c, n = (np.array(v, np.int64) for v in (mine, node, c, n))
            profile = np.frombuffer(b"".join(profile), np.uint8).reshape(-1, PROFILE)
            first, second = [], []
            for r in np.flatnonzero(block == i[0]).tolist():
                to = np.flatnonzero((block == j[0]) & (node > node[r]) & (c != c[r])) if i[0] == j[0] else (
                    np.flatnonzero((block == j[0]) & (node != node[r]) & (c != c[r]))
                )
                limit = (n[to] + n[r]) * (100 - percent) // (100 + percent)
                to, limit = to[np.abs(n[to] - n[r]) <= limit], limit[np.abs(n[to] - n[r]) <= limit]
                apart = np.maximum(profile[to], profile[r]) - np.minimum(profile[to], profile[r])
                to = to[apart.sum(1, dtype=np.int64) <= limit]
                to = to[first_shared(sigs[r], [sigs[t] for t in to]) == sig[0]]
                near = node[to]
                first.append(np.minimum(near, node[r]))
                second.append(np.maximum(near, node[r]))
            whole = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (first, second)]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in whole], ["a", "b"])

        for batch in batches:
            # The lists stay numbers of eight bytes; as Python's they would take five times that.
            lists_ = arrays_of(batch.column(8))
            for row in zip(*(column.to_pylist() for column in batch.columns[:8]), lists_):
                if held and row[:3] != held[-1][:3]:
                    if len(held) > 1:
                        yield passed(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield passed(held)

    cells = ["sig", "i", "j"]
    dealt = members.select(*cells, "mine", "node", "c", "n", "profile", "sigs").repartition(*cells).sortWithinPartitions(*cells)
    return dealt.mapInArrow(meet, "a long, b long").distinct().join(done, ["a", "b"], "left_anti")


def keep_first_of_groups(
    df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``df`` with one document of each component, that with the smallest key.

    Rows that repeat a key are one document, of which the row with the smallest text stays.
    Rows with a null key link with nothing and stay.
    """
    linked = link_documents(df, size, percent, key, text)
    own = F.col(f"`{key}`")
    others = linked.where(own != F.col("component_id")).select(own.alias("_k")).distinct()
    others = sent_if_few(others)
    kept = df.join(others, own == others["_k"], "left_anti")
    often = df.where(own.isNotNull()).groupBy(own.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    often = written(often.where("_n > 1").select("_k"))
    if not often.limit(1).count():
        return kept
    place = free_name(df, "_place")
    order = Window.partitionBy(own).orderBy(F.col(text))
    repeated = kept.join(often, own == often["_k"], "left_semi")
    first = repeated.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return kept.join(often, own == often["_k"], "left_anti").unionByName(first)
