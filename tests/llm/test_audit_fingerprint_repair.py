"""The filter audit, the fingerprints and the conversation repair on small tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from compare import differences, oracle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallyguard.llm import fingerprints as fp
from tallyguard.llm.conversations import damaged, digest_conversations, repair_conversations
from tallyguard.llm.filter_audit import audit_documents, audit_filters
from tallyguard.llm.galloping import difference, shared, union

QUERIES, SQL = contract.queries(), contract.oracle_sql()
IDS = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(st.lists(IDS, max_size=5), IDS, IDS)
def test_galloping_merges_are_set_operations(lists, a, b):
    assert union(lists) == sorted(set().union(*lists))
    assert difference(a, b) == sorted(set(a) - set(b))
    assert shared(a, b) == sorted(set(a) & set(b))


LABELS = "doc_id long, quality int, toxic int"


def plain_audit(documents, labels):
    """Every order and step, row by row."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, lang in documents:
        t = text or ""
        words = t.split()
        capitals = sum("A" <= c <= "Z" for c in t)
        same = [d for d, x, _ in documents if d is not None and (x or "") == t]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * capitals > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and min(same) < doc_id,
        }
        rows.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                total[x] += len(gone)
                failing = [r for r in mine if r[1][x]]
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    len(failing) - len(gone),
                    sum(sum(r[1].values()) == 1 for r in failing),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def test_audit_equals_plain_python(spark, monkeypatch):
    from tallyguard.llm import filter_audit

    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 3)
    long = " ".join(f"w{i}" for i in range(250))
    documents = [
        (1, long, "en"),
        (2, long, "en"),
        (2, long, "en"),
        (3, None, None),
        (4, "", ""),
        (None, long, "en"),
        (None, None, "de"),
        (5, "AB cd # " * 300, "de"),
        (6, "AB cd # " * 300, "de"),
        (7, "x" * 300_000, "en"),
        (8, "Só é ü " * 250, "de"),
        (9, long + " |", "de"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    columns = "doc_id long, text string, lang string"
    df = spark.createDataFrame(documents, columns)
    # Columns with the names that the operator uses itself.
    df = df.withColumns({c: F.lit("x") for c in ("A", "E", "_text_key", "_first_id", "good", "part", "label_id")})
    found = audit_documents(df, spark.createDataFrame(labels, LABELS)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    # Only ASCII white space separates words.
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in found} == plain_audit(
        [(d, t and t.replace(" ", "_"), x) for d, t, x in documents], labels
    )
    empty = audit_documents(df.limit(0), spark.createDataFrame(labels, LABELS))
    assert empty.columns == audit_documents(df, spark.createDataFrame(labels, LABELS)).columns
    assert empty.count() == 0


def test_audit_of_own_filters_and_orders(spark):
    df = spark.createDataFrame([(True, None), (True, True), (False, True)], "x boolean, y boolean")
    found = audit_filters(df.withColumn("p", F.lit("a")), {"X": "x", "Y": "y"}, "p", orders=["YX"]).collect()
    assert [(r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found] == [
        (1, 1, 2, 0, 1, 3),
        (2, 0, 1, 1, 1, 3),
    ]
    with pytest.raises(ValueError):
        audit_filters(df, {"X": "x"}, "y", orders=["XZ"])


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_conversation_repair"])
def test_equals_sql_on_the_larger_table(spark, name):
    folder = "/root/testdata/sf0.01"
    found = QUERIES[name](spark, folder)
    result = oracle(folder).execute(SQL[name])
    names = [d[0] for d in result.description]
    assert differences(found.collect(), found.columns, result.fetchall(), names) is None


def edited(mine, following):
    m = len(mine) // 4
    return mine[: len(mine) - m] + following[:m]


def check_fingerprints(rows, texts):
    """``texts``: (id, text) in order; the rows must be what the texts give one by one."""
    texts = [(i, t or "") for i, t in texts]
    assert len(rows) == len(texts)
    expected = []
    for (i, mine), (_, following) in zip(texts, texts[1:] + texts[:1]):
        new = edited(mine, following)
        sums = [fp.sums_of([fp.paragraphs_of(t)]) for t in (mine, new, following)]
        like = [round(float(fp.likeness(sums[0], other)[0]), 9) for other in sums[1:]]
        expected.append((i, len(mine), hashlib.sha256(new.encode()).hexdigest(), fp.fingerprint(mine), fp.fingerprint(new), *like))
    found = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_fingerprint_query_equals_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    rows = QUERIES["op12_fingerprints"](spark, folder).collect()
    check_fingerprints(rows, [(d.doc_id, d.text) for d in docs])
    assert np.mean([r.near_edited for r in rows]) > 0.7 and np.mean([r.near_next for r in rows]) < 0.15


def test_fingerprints_of_odd_tables(spark, monkeypatch):
    texts = [
        (-3, "a b c d\n\nc d e f"),
        (1, None),
        (2, ""),
        (3, "x"),
        (4, "\n"),
        (5, "é" * 9 + "\n" + "word " * 40),
        (5, "中文 " * 50),
        (5, "中文 " * 50),
        (9, "line one two three\n" * 500 + "z" * 200_000),
        (1 << 40, "one two three four five"),
        (None, "one two three four six"),
        (None, "two"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("id", "range", "head", "_task_group", "before", "lead_id")})
    ordered = [t for t in texts if t[0] is not None] + sorted(t for t in texts if t[0] is None)
    # Rows with equal ids go by text.
    ordered[5:8] = sorted(ordered[5:8], key=lambda t: t[1].encode())
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(fp, "CHUNK", chunk)
        if chunk == 1 << 20:
            check_fingerprints(fp.fingerprint_documents(df.repartition(3)).collect(), ordered)
    monkeypatch.undo()
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    [one] = fp.fingerprint_documents(df.where("doc_id = 3")).collect()
    assert (one.near_next, one.near_edited, one.edited_sha256) == (1.0, 1.0, hashlib.sha256(b"x").hexdigest())
    nulls = fp.fingerprint_documents(df.where("doc_id is null")).collect()
    check_fingerprints(nulls, ordered[-2:])


def test_fingerprint_is_a_homomorphic_multiset_hash():
    lines = [f"line {i} with words {i * i}" for i in range(20)] + ["twice", "twice", ""]
    whole = fp.fingerprint("\n".join(lines))
    random.Random(1).shuffle(lines)
    assert fp.fingerprint("\n".join(lines)) == whole
    less = fp.changed(whole, deleted=["twice", "line 3 with words 9"], inserted=["new words here"])
    left = [x for x in lines if x != "line 3 with words 9"]
    left.remove("twice")
    assert less == fp.fingerprint("\n".join([*left, "new words here"])) != whole
    assert fp.fingerprint("twice") != fp.fingerprint("twice\ntwice")


def test_likeness_follows_shared_shingles():
    words = [f"w{i}" for i in range(2000)]
    a = fp.sums_of([[" ".join(words).encode()]])
    for share in (0.9, 0.5, 0.0):
        kept = int(2000 * share)
        b = fp.sums_of([[" ".join(words[:kept] + [f"v{i}" for i in range(2000 - kept)]).encode()]])
        assert fp.likeness(a, b)[0] == pytest.approx(share, abs=0.2)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Least (cost, audit) over all edits, by exhaustion over (row, state) from the front."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()),
    )
    white = " \t\n\v\f\r"
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(white)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        faults.append(fault)
        seen.add((role, text))
    best = {}
    # Paths with at most two inserted turns in front of a row; more never pay.
    paths = [(0, "", (), "")]  # cost, audit, lines, roles

    def legal(roles):
        body = roles[1:] if roles[:1] == "s" else roles
        return all(c == "ua"[i % 2] for i, c in enumerate(body))

    def with_inserts(paths):
        out = list(paths)
        for _ in range(2):
            more = []
            for cost, audit, lines, roles in out:
                for role in ("user", "assistant"):
                    if legal(roles + role[0]):
                        more.append((cost + 3, audit + "I", (*lines, f"{role}:"), roles + role[0]))
            out = list({(p[0], p[1], p[2]): p for p in out + more}.values())
        return out

    for (_, role, text), fault in zip(rows, faults):
        following = []
        for cost, audit, lines, roles in with_inserts(paths):
            following.append((cost + 4, audit + "D", lines, roles))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            options = [(0, "K", role)] + [(3, "R", r) for r in ("user", "assistant")]
            for price, edit, new in options:
                if new[:1] in ("s", "u", "a") and (new[:1] != "s" or not roles) and legal(roles + new[:1]):
                    following.append((cost + price + extra, audit + edit, (*lines, f"{new}:{text}"), roles + new[:1]))
        # Paths that end alike are pruned by cost alone; ties are all kept.
        least = {}
        for p in following:
            least[p[3][-1:]] = min(least.get(p[3][-1:], 99999), p[0])
        paths = [p for p in following if p[0] <= least[p[3][-1:]]]
    ends = [p for p in with_inserts(paths) if not p[3] or (p[3][-1] == "a")]
    cost, audit, lines, _ = min(ends, key=lambda p: (p[0], p[1]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def found_repairs(df, **sizes):
    rows = digest_conversations(repair_conversations(df, **sizes)).collect()
    return {r.conv_id: tuple(r)[1:] for r in rows}


def random_conversations(seed, conversations, turns):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None, ""]
    texts = ["Hi.", "Hi.", "no end", " ", "", None, "Wow!\n", "é?", "more. ", "a\nb."]
    out = {}
    for c in [*range(conversations), None]:
        n = rng.randint(0, turns)
        out[c] = [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    return out


def test_repair_equals_exhaustion(spark):
    made = {c: r for c, r in random_conversations(1, 250, 6).items() if r}
    rows = [(c, *r) for c, mine in made.items() for r in mine]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit(1) for c in ("number", "rows", "n", "present")})
    expected = {c: plain_repair(r) for c, r in made.items()}
    assert found_repairs(df) == expected
    # The same rows in chunks, which long conversations are cut into.
    assert found_repairs(df, chunk_rows=2) == expected
    assert found_repairs(df, chunk_bytes=5) == expected
    assert found_repairs(df.limit(0)) == {}


def test_long_conversation_in_chunks_equals_whole(spark):
    rng = random.Random(7)
    rows = [(c, t // 3, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["a.", "b", "", f"t{t}."])) for c in (1, 2) for t in range(3000)]
    rows.append((3, 1, "user", "x" * 300_000 + "."))
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert found_repairs(df, chunk_rows=100) == found_repairs(df)


def test_rows_that_are_not_present_leave_their_conversation(spark):
    df = spark.createDataFrame([(1, 1, "user", "a."), (2, None, "user", "b.")], CONVERSATIONS)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = digest_conversations(repair_conversations(df, present=F.col("turn").isNotNull())).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {
        1: (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:a.\nassistant:").hexdigest()),
        2: nothing,
    }


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b? c") for c in range(20) for t in range(20)] + [(None, None, None, None), (None, 3, "user", "x!")]
    found, present = damaged(spark.createDataFrame(rows, CONVERSATIONS))
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else " " if role is None else role
        expected += [(c, t, role, text)] * ((kind == 3) + (kind != 0))
    got = [tuple(r) for r in found.where(present).drop("kind").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
