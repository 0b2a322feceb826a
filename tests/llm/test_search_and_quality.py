"""Top-k search and the quality classifier."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import topk
from tallyguard.llm.lm_scores import log_scores
from tallyguard.llm.quality import MEASURES, _packed, _unpacked, keep_quality, measures_of, score_quality


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, k):
    usable = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            usable.setdefault((i, q), None)
    out = []
    for q in sorted({i for i, _ in usable if i % 2 == 0}):
        mine = [v for i, v in usable if i == q]
        scores = {
            (-sum(a * b for a, b in zip(v, w)), i)
            for v in mine
            for i, w in usable
            if i != q and len(v) == len(w)
        }
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("blocks", [(4096, 256), (7, 3)])
def test_top_k_equals_brute_force(spark, blocks):
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(40)], i) for i in range(60)]
    rows += [(100 + i, rows[i][1], 0) for i in range(8)]  # ties
    rows += [rows[3], rows[4], (4, [1.0] * 40, 0)]  # repeated rows, a repeated id
    rows += [(200, [1.0, 2.0], 0), (202, [3.0, 4.0], 0), (204, [], 0)]
    rows += [(300, None, 0), (302, [None] * 40, 0), (304, [float("nan")] * 40, 0), (306, [float("inf")] * 40, 0)]
    rows += [(None, [0.5] * 40, 0)]
    df = vectors(spark, rows)
    found = topk.top_k(df, F.col("vec_id") % 2 == 0, 5, candidates=blocks[0], queries=blocks[1])
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5)


def test_top_k_of_nothing(spark):
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(2, [1.0], 0)]), F.col("vec_id") % 2 == 0).count() == 0


def test_bounds_drop_candidates_but_never_a_best_one():
    rng = np.random.default_rng(0)
    matrix = rng.integers(-300, 300, (64, 500))
    matrix[:16] *= 8  # a strong first block makes the bounds bite
    queries = rng.integers(-300, 300, (20, 64))
    full = queries @ matrix
    for q, (at, score) in enumerate(topk.best_of_block(queries, matrix, 5)):
        assert len(at) < 500
        assert (score == full[q, at]).all()
        assert set(np.argsort(-full[q], kind="stable")[:5]) <= set(at.tolist())


def test_large_components_stay_exact():
    big = 1 << 28
    matrix = np.array([[big, big + 1], [1, 0]])
    ((at, score),) = topk.best_of_block(np.array([[big, 1]]), matrix, 2)
    assert sorted(zip(at.tolist(), score.tolist())) == [(0, big * big + 1), (1, big * big + big)]


def test_measures():
    assert measures_of(None) == measures_of(" \n ") == [0.0] * len(MEASURES)
    shout, calm = measures_of("BUY NOW!! " * 50), measures_of("A calm line of words, then another one.")
    at = MEASURES.index
    assert shout[at("upper")] > calm[at("upper")] and shout[at("distinct")] < calm[at("distinct")]


def test_held_out_quality(spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    documents = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = score_quality(documents, labels.where("doc_id % 2 = 0"))
    rows = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "keep").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_sparse_sites_are_shrunk_to_the_global_rate(spark, documents):
    calm = "a plain sentence with some words in it number {} of the day"
    rows = [(i, calm.format(i), "en", "large") for i in range(200)]
    rows += [(200 + i, calm.format(i), "en", "bad") for i in range(200)]
    rows += [(900, calm.format(3), "en", "tiny"), (901, calm.format(4), None, None)]
    labels = [(i, int(i < 200), 0) for i in range(400)] + [(900, 0, 0), (901, None, 0), (901, 1, 1), (901, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in score_quality(documents(rows), labels).collect()}
    assert len(found) == 402
    assert found[0].host_rate > 0.9 and found[300].host_rate < 0.1
    # A document's own label does not count for its site; a site of one has the global rate.
    assert 0.4 < found[900].host_rate < 0.6
    assert (found[901].host, found[901].path) == ("", "")


def test_quality_without_labels_rows_or_keys(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_quality(documents([]), none).count() == 0
    rows = [(1, "some text"), (1, "some text"), (None, None), (2, ""), (3, "x " * 100_000)]
    df = documents(rows).withColumn("host", F.lit(1)).withColumn("keep", F.lit("mine"))
    kept = keep_quality(df, none)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_held_out_toxic(spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = score_quality(documents, labels.where("doc_id % 2 = 0")).select("doc_id", "keep", F.col("toxic").alias("found"))
    rows = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic, clean = [[r for r in rows if r.toxic == y] for y in (1, 0)]
    good = [r for r in clean if r.quality == 1]
    print(
        f"toxic {sum(r.found for r in toxic)}/{len(toxic)}, clean lost {sum(r.found for r in clean)}/{len(clean)}, "
        f"bad {sum(not r.keep for r in rows if r.quality == 0)}/{sum(r.quality == 0 for r in rows)}, "
        f"good lost {sum(not r.keep for r in rows if r.quality == 1)}/{sum(r.quality == 1 for r in rows)}, "
        f"good and clean lost by either {sum(r.found or not r.keep for r in good)}/{len(good)}"
    )
    assert sum(r.found for r in toxic) / len(toxic) > 0.85
    assert sum(r.found for r in clean) / len(clean) < 0.02


def test_toxic_documents_go_and_one_class_tells_nothing(spark, documents):
    calm = "a plain sentence with some words in it number {} of the day"
    rows = [(i, calm.format(i) + (" you idiot" if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(100)]
    shape = "doc_id long, quality int, toxic int"
    kept = keep_quality(documents(rows), spark.createDataFrame(labels, shape))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 4}
    for y in (0, 1, None):
        same = spark.createDataFrame([(i, 1, y) for i, *_ in labels], shape)
        assert keep_quality(documents(rows), same).count() == 200
    assert keep_quality(documents(rows), same.drop("toxic")).count() == 200


def test_buckets_are_packed_and_read_again():
    for buckets in ([], [0], [65534, 65535, 65536, 262143], [131070], [196605, 262143]):
        assert _unpacked(_packed(np.array(buckets, np.int64))).tolist() == buckets


def test_components_that_overflow_are_an_error(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(4)] + [(4, [1e30, 0.0], 0)]
    with pytest.raises(Exception, match="too large"):
        topk.top_k(vectors(spark, rows), F.col("vec_id") % 2 == 0).collect()
    found = topk.top_k(vectors(spark, rows[:4] + [(4, [4e6, 0.0], 0)]), F.col("vec_id") % 2 == 0).collect()
    assert max(r.score for r in found) == 256 * 256 * 4_000_000


def test_scores_come_from_two_counts():
    both, base = np.array([1, 2, 5]), np.array([8, 4, 10])
    value, unseen = log_scores(both, base, 0.4, 2)
    assert unseen.tolist() == [True, False, False]
    assert np.allclose(value, np.log([0.4 * 8, 2 / 4, 5 / 10]), atol=1e-12)
