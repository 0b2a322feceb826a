"""The registered queries over filters, fingerprints and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.common import query, table
from tallyguard.llm.conversations import damaged, digest_conversations, repair_conversations
from tallyguard.llm.filter_audit import audit_documents
from tallyguard.llm.fingerprints import fingerprint_documents


@query(
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
    e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
    l AS (
      SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    marked AS (
      SELECT part,
        (len(ws) < 200)::INT
        + 2 * (100 * list_unique(ws) < 50 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(w.doc_id > e.least, false)::INT AS mask,
        coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM w JOIN e USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
    bits AS (
      SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM marked GROUP BY part, mask),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
    orders AS (
      SELECT v.x || w.x || y.x || z.x || q.x AS filter_order, [v.b, w.b, y.b, z.b, q.b] AS bs
      FROM letters v, letters w, letters y, letters z, letters q
      WHERE (v.b | w.b | y.b | z.b | q.b) = 31),
    steps AS (
      SELECT filter_order, step, bs[step] AS b, coalesce(list_sum(bs[1 : step - 1]), 0)::INT AS earlier
      FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
    found AS (
      SELECT part, filter_order, step, b,
        coalesce(sum(n) FILTER ((mask & (b | earlier)) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER ((mask & b) <> 0 AND (mask & earlier) = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER ((mask & b) <> 0 AND (mask & earlier) <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER ((mask & b) <> 0 AND (mask & earlier) = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER ((mask & b) <> 0 AND (mask & earlier) = 0), 0)::BIGINT AS toxic_lost
      FROM bits, steps GROUP BY part, filter_order, step, b)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
    FROM found"""
)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents"))


# The SQL of the repair carries, per stack top, the whole least (cost, audit, text) of the rest
# of the conversation, from the last row to the first. An audit decides its text.
_NONE = "{'c': 1000000000, 'a': '', 't': ''}"
_END = "{'c': 0, 'a': '', 't': ''}"


def _joined(cost: str, edit: str, line: str, rest: str) -> str:
    text = f"{line} || CASE WHEN {rest}.t = '' THEN '' ELSE chr(10) || {rest}.t END"
    return f"{{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 't': {text}}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _row_edits(top: int) -> str:
    """The least continuation of a stack top that edits the row now."""
    to, role = (3, "assistant") if top == 2 else (2, "user")
    keep = _joined("r.extra", "K", "r.role || ':' || r.text", f"n.b{to}")
    rerole = _joined("3 + r.extra", "R", f"'{role}:' || r.text", f"n.b{to}")
    system = _joined("r.extra", "K", "r.role || ':' || r.text", "n.b1")
    ways = [
        f"{{'c': 4 + n.b{top}.c, 'a': 'D' || n.b{top}.a, 't': n.b{top}.t}}",
        f"CASE WHEN r.gone THEN {_NONE} WHEN r.i = '{role[0]}' THEN {keep} ELSE {rerole} END",
    ]
    if top == 0:
        ways.append(f"CASE WHEN r.gone OR r.i <> 's' THEN {_NONE} ELSE {system} END")
    return _least(*ways)


def _with_inserts(source: str) -> str:
    """Adds inserted turns in front of the continuations x0 to x3."""
    return f"""
      SELECT conv_id, k, {_least('x0', _joined('3', 'I', "'user:'", 'y2'))} AS b0,
             {_least('x1', _joined('3', 'I', "'user:'", 'y2'))} AS b1, y2 AS b2, y3 AS b3
      FROM (SELECT *, {_least('x2', _joined('3', 'I', "'assistant:'", 'x3'))} AS y2,
                   {_least('x3', _joined('3', 'I', "'user:'", 'x2'))} AS y3
            FROM ({source}))"""


_EDITED = f"""
    SELECT r.conv_id, r.k, {_row_edits(0)} AS x0, {_row_edits(1)} AS x1, {_row_edits(2)} AS x2, {_row_edits(3)} AS x3
    FROM n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.k = n.k - 1"""

# The reversed CRC-32 polynomial; the table of 256 remainders and the checksum follow from it.
_CRC = 3988292384


@query(
    rf"""
    WITH RECURSIVE c AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
      FROM conversations),
    remainders AS (
      SELECT list(list_reduce(list_prepend(v, range(8)),
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {_CRC}) ELSE a >> 1 END) ORDER BY v) AS x
      FROM (SELECT unnest(range(256)) AS v)),
    kinds AS (
      SELECT c.*, xor(list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda s: ascii(s)::BIGINT)),
          lambda a, s: xor(a >> 8, x[(xor(a, s) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
      FROM c, remainders),
    rows_after AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM kinds, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    placed AS (
      SELECT *, left(role, 1) AS i,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
      FROM rows_after),
    judged AS (
      SELECT *, CASE WHEN blank THEN 'b'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
                  WHEN cut THEN 't' ELSE '' END AS fault,
             lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS prior
      FROM placed),
    r AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM judged),
    n AS (
      {_with_inserts(f'SELECT conv_id, max(k) + 1 AS k, {_END} AS x0, {_NONE} AS x1, {_NONE} AS x2, {_END} AS x3 FROM r GROUP BY conv_id')}
      UNION ALL
      {_with_inserts(_EDITED)}),
    best AS (SELECT conv_id, b0 FROM n WHERE k = 1),
    counts AS (
      SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal
      FROM r GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0.c, 0)::BIGINT AS cost,
           coalesce(b0.a, '') AS audit, sha256(coalesce(b0.t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""
)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows, present = damaged(table(spark, folder, "conversations"))
    return digest_conversations(repair_conversations(rows, present=present))
