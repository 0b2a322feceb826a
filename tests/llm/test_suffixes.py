"""Suffix arrays and the removal of repeats, against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyguard.llm import suffix_dedup
from tallyguard.llm.suffixes import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-2, 3), max_size=40), st.integers(1, 4))
def test_suffix_array(symbols, times):
    symbols = symbols * times
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(d, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(documents, texts, length):
    rows = suffix_dedup.count_repeats(documents(list(enumerate(texts))), length=length).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def texts_with_repeats(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(rng.randint(90, 300)) for _ in range(4)]
    out = []
    for _ in range(14):
        parts = [word(rng.randint(0, 150)) for _ in range(3)]
        for i in range(2):
            piece = rng.choice(shared)
            a = rng.randint(0, 40)
            parts.insert(2 * i + 1, piece[a : len(piece) - rng.randint(0, 40)])
        out.append("".join(parts))
    out += [out[0], out[0][:-1], "x" * 500, "ab" * 260, word(99), word(100), shared[1], "", None, None]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_plain_python(documents, seed):
    texts = texts_with_repeats(seed)
    assert found(documents, texts, 100) == plain(texts, 100)


def test_crowded_cores_are_counted_alike(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GATHERED", 1)
    texts = texts_with_repeats(3)
    assert found(documents, texts, 100) == plain(texts, 100)


def test_long_texts_are_cut_into_parts(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BITS", 20)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_100_000))
    texts = [long, "z" + long[1_048_000:1_049_500] + "y", long[5:700]]
    rows = found(documents, texts, 400)
    assert rows[0][:3] == (1_100_000, 1500 + 695, 2)
    assert rows[1][:3] == (1502, 1500, 1)
    assert rows[2][:3] == (695, 695, 1)


def test_null_ids_repeated_rows_and_extra_columns(spark, documents):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    df = documents([(None, text), (7, text), (7, text), (None, "short"), (8, None)])
    rows = suffix_dedup.count_repeats(df.withColumn("digest", df.doc_id)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [
        (0, 5, 0, 0), (0, 450, 450, 1), (7, 450, 450, 1), (7, 450, 450, 1), (8, 0, 0, 0),
    ]
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == df.columns
    assert sorted((r.text is None, r.text or "") for r in cut.collect()) == [
        (False, ""), (False, ""), (False, ""), (False, "short"), (True, ""),
    ]


def test_texts_of_null_ids_are_looked_up(documents):
    shared = "".join(chr(97 + (i * i * 3 + i // 5) % 26) for i in range(420))
    rows = suffix_dedup.count_repeats(documents([(None, "one " + shared), (1, "two " + shared + " end")])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(424, 421, 1), (428, 421, 1)]


def test_empty_table(documents):
    assert suffix_dedup.count_repeats(documents([])).count() == 0
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_query_takes_passages_of_51_words_by_their_bytes(spark, folder, tmp_path):
    """The contract counts bytes: 400 that occur twice go, 399 stay, whatever the number of words."""
    import __spark_entry__ as contract

    rng = random.Random(7)
    shape = lambda letters: [letters // 51 + (i < letters % 51) for i in range(51)]
    short, enough = (
        " ".join("".join(rng.choice("abcdefgh") for _ in range(n)) for n in shape(letters)) for letters in (349, 350)
    )
    assert (len(short), len(enough)) == (399, 400)
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    top = max(r.doc_id for r in rows)
    planted = [f"1{short}2", f"3{short}4", f"5{enough}6", f"7{enough}8"]
    more = [(top + 1 + i, t, "en", "src0", len(t)) for i, t in enumerate(planted)]
    whole = spark.createDataFrame([tuple(r) for r in rows] + more, spark.createDataFrame(rows).schema)
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[:5] for r in contract.queries()["op3_suffix_dedup"](spark, str(tmp_path)).collect())
    inputs = sorted((r.doc_id, r.text) for r in whole.collect())
    assert got == [(i, *w) for (i, _), w in zip(inputs, plain([t for _, t in inputs], 400))]
    assert [g[2] for g in got[-4:]] == [0, 0, 400, 400]
