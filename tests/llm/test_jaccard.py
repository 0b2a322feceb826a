"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import jaccard
from tallyguard.llm.links import components


def plain(rows, size, percent):
    sets = [(i, jaccard.shingles_of(jaccard.words_of(t), size)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    while True:
        before = dict(label)
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return sorted((-1 if i is None else i, len(s), label.get(i)) for i, s in sets)


def some_texts(seed, words=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, 7)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = word()
            rows.append((rng.choice(" \n\t").join(text)).upper() if rng.random() < 0.2 else " ".join(text))
            base = text if rng.random() < 0.4 else base  # chains of small changes
    rows += ["same short", "same  SHORT", "x", "", None, " \n", "y " * 3000, "y " * 3001 + "z"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows))


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_components_equal_all_pairs(documents, size, percent, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "MET", 3)
    rows = some_texts(seed)
    rows.append((None, rows[0][1]))
    df = documents(rows).withColumn("node", F.lit(1)).withColumn("component", F.lit(2))
    found = jaccard.link_documents(df, size, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in found) == plain(
        rows, size, percent
    )


def test_first_shared_number():
    rng = random.Random(1)
    lists = [np.array(sorted(rng.sample(range(-40, 40), rng.randint(1, 9))), np.int64) for _ in range(200)]
    for mine in lists[:20]:
        found = jaccard.first_shared(mine, lists)
        for other, value in zip(lists, found):
            common = set(mine.tolist()) & set(other.tolist())
            assert value == (min(common) if common else np.iinfo(np.int64).max)
    assert len(jaccard.first_shared(lists[0], [])) == 0


def test_any_plan_finds_every_linked_pair():
    rng = np.random.default_rng(2)
    for _ in range(400):
        percent = int(rng.choice([60, 80, 90]))
        n = int(rng.integers(1, 80))
        base = jaccard.largest_difference(n, jaccard.largest_partner(n, percent), percent) + 1
        spare, deleted = int(rng.integers(0, 4)), 0
        deleted = int(rng.integers(0, (base + spare) // 2 + 1))
        plan = jaccard.Plan(n, n, base + spare - 2 * deleted, deleted, spare)
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        for _ in range(100):
            smaller = np.unique(np.delete(b, rng.integers(len(b)))) if len(b) > n - 3 and rng.random() < 0.5 else b
            c = np.unique(np.append(smaller, rng.integers(0, 1 << 62, 1).astype(np.uint64)))
            common = len(np.intersect1d(a, c))
            if 100 * common < percent * (len(a) + len(c) - common) or not n <= len(c) <= jaccard.largest_partner(n, percent):
                break
            b = c
        shared = np.intersect1d(jaccard.signatures(np.sort(a), plan, 3), jaccard.signatures(np.sort(b), plan, 3))
        assert len(shared) or (len(b) < n)


def test_costs_choose_larger_segments_for_more_sets():
    few, many = (jaccard.allocate(10, 12, sets, 80) for sets in (10, 10**9))
    assert few.exact + 2 * few.deleted == jaccard.largest_difference(12, 15, 80) + 1 + few.spare
    assert many.deleted > few.deleted or many.spare > few.spare


def test_one_row_of_each_group_stays(documents):
    long = " ".join(f"word{i}" for i in range(100))
    rows = [(4, long), (2, long + " more"), (9, long), (9, long), (1, "else"), (1, "else"), (None, long), (3, None), (5, None)]
    kept = jaccard.keep_first_of_groups(documents(rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5]
    assert kept.columns == documents(rows).columns
    assert jaccard.keep_first_of_groups(documents([])).count() == 0


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(201)} | {(300, 300), (301, 300)}
