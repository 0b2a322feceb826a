"""Registered queries against their SQL, or against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import differences, oracle
from tokenizers import Tokenizer

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()
MINE = sorted(q for q in QUERIES if q.startswith("op") or q == "pipeline")


def texts_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


def encoded(file, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_all_are_registered():
    assert {q.split("_")[0] for q in MINE if q != "pipeline"} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in MINE


@pytest.mark.parametrize("name", [q for q in MINE if q in SQL])
def test_equals_sql(spark, folder, name):
    found = QUERIES[name](spark, folder)
    result = oracle(folder).execute(SQL[name])
    names = [d[0] for d in result.description]
    assert differences(found.collect(), found.columns, result.fetchall(), names) is None


def test_token_counts(spark, folder):
    texts = texts_of(spark, folder)
    found = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, folder).collect()}
    assert len(found) == len(texts)
    for (name, text), ids in zip(texts, encoded("word_bpe_49k.json", [t for _, t in texts])):
        row = found[name]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), len(ids), len(ids) > 2048)


def test_packing_is_whole_and_tight(spark, folder):
    texts = texts_of(spark, folder)
    ids = {n: i + [1] for (n, _), i in zip(texts, encoded("word_bpe_49k.json", [t for _, t in texts]))}
    rows = QUERIES["op6_packing"](spark, folder).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for name, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[name]))
            assert r.ids_crc32 == crc(ids[name][at : at + r.length])
            at += r.length
        assert at == len(ids[name])
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(r.length for r in rows)
    # Remains are not cut, so the last windows of a group may miss the fewest possible by one.
    assert len(sequences) <= -(-used // 2048) + 1


def test_token_files(spark, folder):
    texts = texts_of(spark, folder)
    found = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, folder).collect()}
    at = 0
    for (name, _), ids in zip(texts, encoded("byte_bpe_50k.json", [t for _, t in texts])):
        row = found[name]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1


def test_lm_scores(spark, folder):
    texts = texts_of(spark, folder)
    marked = {
        n: ["<", *i, ">"] for (n, _), i in zip(texts, encoded("word_bpe_49k.json", [t for _, t in texts]))
    }
    pairs, first, second = Counter(), Counter(), Counter()
    for ids in marked.values():
        pairs.update(zip(ids, ids[1:]))
        first.update(ids[:-1])
        second.update(ids[1:])
    total = sum(second.values())
    found = {r.doc_id: r for r in QUERIES["op7_lm_scores"](spark, folder).collect()}
    for name, ids in marked.items():
        steps = list(zip(ids, ids[1:]))
        score = sum(
            math.log(pairs[p] / first[p[0]]) if pairs[p] > 1 else math.log(0.4 * second[p[1]] / total)
            for p in steps
        )
        assert found[name].log_score == pytest.approx(score, rel=1e-6)
        assert found[name].n_unseen == sum(pairs[p] < 2 for p in steps)


def test_pipeline_keeps_every_stage_in_shape(spark, folder):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0.5 * before < len(kept) < before
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
