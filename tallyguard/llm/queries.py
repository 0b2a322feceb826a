"""The registered queries of this folder, each next to its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import query, table
from tallyguard.llm.decontaminate import mark_contamination
from tallyguard.llm.jaccard import link_documents
from tallyguard.llm.lm_scores import score_documents
from tallyguard.llm.packing import pack_documents
from tallyguard.llm.pii import replace_entities
from tallyguard.llm.quality import score_quality
from tallyguard.llm.simple8b import read_token_checksums, write_token_files
from tallyguard.llm.suffix_dedup import count_repeats
from tallyguard.llm.tokens import count_tokens
from tallyguard.llm.topk import top_k

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(
    _ASCII_LOWER.format("coalesce(text, '')")
)


@query(
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 50 = 0),
    r AS (
      SELECT query_id, vec_id, score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
      FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
)
def op1_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return count_repeats(table(spark, folder, "documents"), length=400)


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(table(spark, folder, "documents").select("doc_id", "text"), path, limit=2048)


#: A stand-in; users pass their own secret, which decides all surrogates.
SURROGATE_KEY = b"not a secret: for tests"


@query()
def op5_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return replace_entities(documents, SURROGATE_KEY, counts=True)


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, folder, "documents"), path, end_id=1, capacity=2048)


@query()
def op7_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    scored = score_documents(table(spark, folder, "documents"), path)
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


@query(
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
    bw AS (
      SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
    sizes AS (SELECT DISTINCT k FROM bw),
    dw AS (
      SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM d, sizes WHERE len(w) >= k)),
    hits AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, win)),
    words_hit AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
    items_hit AS (
      SELECT doc_id, count(*) AS n_items,
             sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)"""
)
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    marked = mark_contamination(documents, table(spark, folder, "benchmark"))
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    names = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = write_token_files(table(spark, folder, "documents"), path, end_id=2)
    return read_token_checksums(spark, files)


_SHINGLES = r"""
    d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),""".format(
    lower=_ASCII_LOWER.format("coalesce(text, '')")
)


@query(
    f"""
    WITH RECURSIVE {_SHINGLES}
    both_in AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS (
      SELECT a, b FROM both_in JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * c >= 90 * (na.n + nb.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents
      UNION
      SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a)
    SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
    FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
)
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(table(spark, folder, "documents"), size=3, percent=90)


from tallyguard.llm import order_queries  # noqa: E402, F401
