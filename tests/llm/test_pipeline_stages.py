"""The pipeline's stages on odd tables, against plain Python where the result is exact."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyguard.llm import jaccard

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with labels and a benchmark."""
    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "short item"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def rows():
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    near = [*base[:150], "other", *base[151:]]
    return [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base).upper()),
        (4, " ".join(base[:40])),
        (4, " ".join(base[:40])),
        (5, None),
        (6, ""),
        (7, "A quick brown fox jumps over the lazy dog again, and the quick brown fox jumps over the lazy dog AGAIN!"),
        (8, "one short item here"),
        (9, "mail me at jane.doe@example.org or call 212-555-0175"),
        (10, "x" * 100_000),
        (None, " ".join(base)),
        (None, None),
    ]


def columns_of(df):
    return df.withColumns({c: F.lit("extra") for c in ("node", "_k", "_place", "component", "keep", "sig")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, documents, folder, name):
    df = columns_of(documents(rows()))
    found = STAGES[name](spark, df, folder)
    assert found.columns == df.columns
    assert {r[0] for r in found.select("node").distinct().collect()} == {"extra"}
    assert STAGES[name](spark, df.limit(0), folder).count() == 0


def test_near_duplicates_equal_plain_python(spark, documents, folder):
    data = rows()
    sets = [(i, t, jaccard.shingles_of(jaccard.words_of(t), 5)) for i, t in data]
    keyed = [(i, s) for i, _, s in sets if i is not None]
    label = {i: i for i, _ in keyed}
    for _ in keyed:
        for i, a in keyed:
            for j, b in keyed:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    expected = sorted({(i, t) for i, t in data if i is not None and label[i] == i}, key=repr)
    expected += [(i, t) for i, t in data if i is None]
    found = STAGES["near_duplicates"](spark, documents(data), folder).select("doc_id", "text").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert {i for i, _ in map(tuple, found)} == {1, 4, 5, 6, 7, 8, 9, 10, None}


def test_decontamination_equals_plain_python(spark, documents, folder):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())

    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        size = min(10, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    data = rows()
    expected = [
        (i, t)
        for i, t in data
        if not any(
            tuple(words(t)[a : a + len(w)]) == w for w in windows for a in range(len(words(t)) - len(w) + 1)
        )
    ]
    found = STAGES["decontamination"](spark, documents(data), folder).select("doc_id", "text").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert len(expected) == len(data) - 2


def test_personal_data_changes_what_is_personal_and_nothing_else(spark, documents, folder):
    data = rows()
    found = STAGES["personal_data"](spark, documents(data), folder).collect()
    assert len(found) == len(data)
    texts = [(r.doc_id, r.text) for r in found]
    plain = [(i, t) for i, t in data if i != 9]
    assert sorted([x for x in texts if x[0] != 9], key=repr) == sorted(plain, key=repr)
    [clean] = [t for i, t in texts if i == 9]
    assert "jane.doe@example.org" not in clean and "212-555-0175" not in clean
    assert re.fullmatch(r"mail me at \S+@\S+ or call \d{3}-\d{3}-\d{4}", clean)
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None)


def test_packing_is_whole_on_odd_tables(spark, documents, folder):
    data = rows()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in data]
    found = STAGES["packing"](spark, columns_of(documents(data)), folder).collect()
    assert sum(r.length for r in found) == sum(lengths)
    assert {r.doc_id for r in found} == {i for i, _ in data}
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert STAGES["packing"](spark, documents([]), folder).count() == 0


def test_batches_of_long_texts_are_bounded_in_bytes(spark, documents, folder):
    STAGES["decontamination"](spark, documents(rows()), folder)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    long = documents([(i, "x" * 1_000_000) for i in range(40)]).coalesce(1).select("text")
    assert max(r[0] for r in long.mapInArrow(sizes, "size long").collect()) < 12_000_000


def test_lists_leave_their_batch_as_numbers():
    column = pa.array([[1, 2], [], [-(1 << 63)]], pa.list_(pa.int64())).slice(1)
    found = jaccard.arrays_of(column)
    assert [a.tolist() for a in found] == [[], [-(1 << 63)]] and all(a.base is None for a in found)
