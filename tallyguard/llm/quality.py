"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on binned text measures gives each document's own evidence. Grouped sums
over all documents (labels where there are some, the classifier's probability elsewhere) give
each host and each path of a host a rate of good documents. Hosts are shrunk toward the global
rate and paths toward their host, with strengths estimated from how much the rates spread
beyond chance; a site with few documents thus says little. A document's log odds are its own
evidence plus those of its path without that document.

Toxic documents have the shapes of clean ones and differ in their words, so a second evidence
is fitted on their labels: shrunk log odds of hashed words and word beginnings, without the
document's own part, summed over its most telling words. The same step over sites follows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from tallyguard.llm.common import free_name, sent_if_few, written
from tallyguard.llm.tokens import forget

#: Weight of an unlabelled document in the counts of its site.
SOFT = 0.5
BINS = 10

MEASURES = [
    "characters", "word_length", "upper", "digits", "marks", "shouts", "symbols", "distinct",
    "top_word", "echoes", "distinct_lines", "packed", "short_words", "sentence", "top_bigram", "odd_case",
]

#: Words and their first letters are counted in so many buckets.
BUCKETS = 1 << 18
BEGINNING = 5
#: Labelled documents that a bucket's prior rate of toxic ones stands for.
PRIOR = 1.0

WORD_MEASURES = ["top_1", "top_2", "top_4", "top_8", "top_16", "above_1", "above_2", "above_3"]

_WORD = re.compile(r"\w+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[^\w\s]")
_SYMBOL = re.compile(r"[|{}<>#*_~^\\=/\[\]@]")


def measures_of(text: str | None) -> list[float]:
    """Numbers about the whole text, in the order of MEASURES; zeros for no text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(MEASURES)
    n, size = len(words), len(text)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    data = text.encode()
    upper = len(_UPPER.findall(text))
    return [
        math.log1p(size),
        sum(map(len, words)) / n,
        upper / size,
        sum(map(str.isdigit, text)) / size if any(c in text for c in "0123456789") else 0.0,
        len(_MARK.findall(text)) / size,
        text.count("!") / n,
        len(_SYMBOL.findall(text)) / n,
        len(seen) / n,
        max(seen.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(data, 1)) / len(data),
        sum(len(w) <= 3 for w in words) / n,
        n / (1 + text.count(".")),
        max(pairs.values(), default=0) / n,
        upper / n,
    ]


def words_of(text: str | None) -> np.ndarray:
    """The distinct buckets of all words and word beginnings, in order."""
    words = set(_WORD.findall(text.lower())) if text else set()
    words |= {w[:BEGINNING] for w in words}
    return np.array(sorted({zlib.crc32(w.encode()) % BUCKETS for w in words}), np.int64)


def _packed(buckets: np.ndarray) -> bytes:
    """Steps between the buckets in two bytes each; a full one goes on in the next."""
    steps = np.diff(buckets, prepend=0)
    cells = steps // 0xFFFF + 1
    out = np.full(int(cells.sum()), 0xFFFF, "<u2")
    out[np.cumsum(cells) - 1] = steps % 0xFFFF
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(steps)[steps != 0xFFFF]


def text_measures(df: DataFrame, text: str = "text", into: str = "measures", words: str = "words") -> DataFrame:
    """``df`` with its text replaced by the array of measures and the packed buckets of words."""
    rest = [c for c in df.columns if c not in (text, into, words)]
    shaped = df.select(*[F.col(f"`{c}`") for c in rest], F.col(text).cast("string").alias("_text"))
    schema = shaped.drop("_text").schema.add(into, ArrayType(DoubleType())).add(words, BinaryType())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            values = pa.array([measures_of(t) for t in texts], pa.list_(pa.float64()))
            buckets = pa.array([_packed(words_of(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values, buckets], [*rest, into, words])

    return shaped.mapInArrow(measure, schema)


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (1 - inside))


def word_evidence(rows: DataFrame, label: str, words: str = "words", into: str = "word_measures") -> tuple[DataFrame, bool]:
    """``rows`` with WORD_MEASURES in place of ``words``, and whether both classes are labelled.

    Each bucket's log odds come from the numbers of labelled documents of either class that
    hold it, without the document at hand. The counts are bounded by the number of buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The bucket behind the last counts the documents.
        sums = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for data, y in zip(*(c.to_pylist() for c in batch.columns)):
                sums[int(y), np.append(_unpacked(data), BUCKETS)] += 1
        held = np.flatnonzero(sums.any(axis=0))
        if len(held):
            yield pa.RecordBatch.from_pydict({"bucket": held, "clean": sums[0, held], "bad": sums[1, held]})

    known = rows.where(F.col(label).isNotNull()).select(words, (F.col(label) >= 0.5).cast("int").alias("y"))
    counted = known.mapInArrow(count, "bucket long, clean long, bad long")
    held = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).toArrow()
    sums = np.zeros((2, BUCKETS + 1))
    for y, name in enumerate(("clean", "bad")):
        sums[y, held["bucket"].to_numpy()] = held[name].to_numpy()
    fits = bool(sums[:, BUCKETS].all())
    rate = (sums[1, BUCKETS] + 0.5) / (sums[:, BUCKETS].sum() + 1.0)
    sent = rows.sparkSession.sparkContext.broadcast(sums)
    rest = [c for c in rows.columns if c not in (words, label, into)]
    schema = rows.select(*[f"`{c}`" for c in rest], label).schema.add(into, ArrayType(DoubleType()))

    def measures(data: bytes, y: float | None) -> list[float]:
        at = _unpacked(data)
        if not len(at):
            return [0.0] * len(WORD_MEASURES)
        clean, bad = sent.value[:, at]
        if y is not None:
            clean, bad = (clean, bad - 1) if y >= 0.5 else (clean - 1, bad)
        odds = np.log((bad + PRIOR * rate) / (clean + PRIOR * (1 - rate))) - math.log(rate / (1 - rate))
        odds = -np.sort(-odds)
        return [*(float(odds[:k].sum()) for k in (1, 2, 4, 8, 16)), *(float((odds > t).mean()) for t in (1, 2, 3))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, data = (c.to_pylist() for c in batch.columns[-2:])
            values = pa.array([measures(d, y) for d, y in zip(data, labels)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*rest, label, into])

    return rows.select(*[f"`{c}`" for c in rest], label, words).mapInArrow(measure, schema), fits


def document_evidence(
    rows: DataFrame,
    label: str = "label",
    measures: str = "measures",
    size: int = len(MEASURES),
    own: str = "own",
) -> DataFrame:
    """``rows`` with ``own``, the classifier's probability, fitted on all labelled rows.

    Measures are cut at deciles of the labelled rows, so that the fit needs no scaling and any
    shape of a measure is seen. Without both classes every row gets the smoothed rate.
    """
    known = rows.where(F.col(label).isNotNull())
    shares = [i / BINS for i in range(1, BINS)]
    stats = known.agg(
        F.count(F.when(F.col(label) >= 0.5, 1)).alias("good"),
        F.count(F.when(F.col(label) < 0.5, 1)).alias("bad"),
        *[
            F.percentile_approx(F.col(measures)[i], shares, 1000).alias(f"m{i}")
            for i in range(size)
        ],
    ).first()
    good, bad = stats["good"], stats["bad"]
    if not good or not bad:
        return rows.withColumn(own, F.lit((good + 1) / (good + bad + 2)))
    cuts = [sorted(set(stats[f"m{i}"])) for i in range(size)]
    steps = [
        (F.col(measures)[i] > F.lit(float(cut))).cast("double")
        for i, inner in enumerate(cuts)
        for cut in inner
    ]
    shaped = rows.withColumn("_steps", array_to_vector(F.array(*steps)))
    fit = LogisticRegression(
        featuresCol="_steps", labelCol="_y", regParam=1e-4, maxIter=60, probabilityCol="_p",
        rawPredictionCol="_r", predictionCol="_c",
    ).fit(shaped.where(F.col(label).isNotNull()).withColumn("_y", (F.col(label) >= 0.5).cast("double")))
    weights = fit.coefficients.toArray().tolist()
    total = F.lit(float(fit.intercept))
    for step, weight in zip(steps, weights):
        total = total + step * F.lit(weight)
    return rows.withColumn(own, 1 / (1 + F.exp(-total)))


def _strength(groups: DataFrame, good: str, n: str, centre: Column) -> float:
    """The prior strength M of rates around ``centre``: 1/M is the spread beyond chance."""
    rate = F.col(good) / F.col(n)
    row = groups.where(F.col(n) > 0).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(F.col(n) * F.col(n)).alias("nn"),
        F.sum(F.col(n) * (rate - centre) * (rate - centre)).alias("spread"),
        F.sum(F.col(n) * centre * (1 - centre)).alias("chance"),
    ).first()
    k, total = row["k"] or 0, row["n"] or 0.0
    if k < 2 or not row["chance"]:
        return 100.0
    size = (total - row["nn"] / total) / (k - 1)
    chance = row["chance"] / total
    excess = (row["spread"] / (k - 1) / chance - 1) / max(size - 1, 1.0)
    return min(max(1 / excess - 1, 2.0), 1e4) if excess > 0 else 1e4


def _shrunk_by_site(judged: DataFrame, label: str, own: str, soft: float, prefix: str = "") -> DataFrame:
    """``judged`` with host_rate, path_rate and posterior of one label, named with ``prefix``."""
    # One sum per site; combined in each task first, so a hot host is no burden.
    part = F.coalesce(F.col(label), F.col(own) * soft)
    weight = F.when(F.col(label).isNotNull(), 1.0).otherwise(F.lit(float(soft)))
    parts = judged.withColumns({"part": part, "weight": weight})
    paths = written(
        parts.groupBy("host", "path").agg(F.sum("part").alias("good"), F.sum("weight").alias("n"))
    )
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = ((total["good"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1.0)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    m_host = _strength(hosts, "host_good", "host_n", F.lit(rate))
    hosts = hosts.withColumn("centre", (F.col("host_good") + m_host * rate) / (F.col("host_n") + m_host))
    sites = paths.join(hosts, "host")
    m_path = _strength(sites, "good", "n", F.col("centre"))
    # A document's own part is taken out of its host and path.
    less = lambda c: F.greatest(c, F.lit(0.0))
    host_rate = (less(F.col("host_good") - F.col("part")) + m_host * rate) / (
        less(F.col("host_n") - F.col("weight")) + m_host
    )
    path_rate = (less(F.col("good") - F.col("part")) + m_path * F.col(f"{prefix}host_rate")) / (
        less(F.col("n") - F.col("weight")) + m_path
    )
    odds = _logit(F.col(own)) - _logit(F.lit(rate)) + _logit(F.col(f"{prefix}path_rate"))
    return (
        parts.join(sites, ["host", "path"])
        .withColumn(f"{prefix}host_rate", host_rate)
        .withColumn(f"{prefix}path_rate", path_rate)
        .withColumn(f"{prefix}posterior", 1 / (1 + F.exp(-odds)))
        .drop("part", "weight", "good", "n", "host_good", "host_n", "centre")
    )


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str | Column = "source",
    path: str | Column = "lang",
    label: str = "quality",
    threshold: float = 0.5,
    soft: float = SOFT,
    carried: Sequence[str] = (),
    toxic: str = "toxic",
    toxic_threshold: float = 0.5,
) -> DataFrame:
    """One row per document: key, host, path, own, host_rate, path_rate, posterior, keep, the
    same four numbers for the label ``toxic`` with the prefix toxic_, whether it is toxic, and
    the ``carried`` columns of ``df``.

    A null host or path is the site ''. A document without words has no evidence of its own
    beyond the zeros of its measures. Repeated labels of a document are averaged, null labels
    are no labels. Repeated rows stay. Without labels every document gets the rate one half
    and stays. ``keep`` goes by ``label`` alone. If ``toxic`` is missing or its labels are of one
    class, nothing tells toxic documents and none counts as toxic. Words are runs of letters and
    digits, so in scripts without spaces a word is a whole run. An empty table gives an empty table.
    """
    site = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    measured = text_measures(
        df.select(F.col(f"`{key}`").alias("key"), site(host).alias("host"), site(path).alias("path"), F.col(text).alias("text"), *[F.col(c).alias(f"carried{i}") for i, c in enumerate(carried)])
    )
    known = labels.select(
        F.col(f"`{key}`").alias("key"),
        F.col(label).cast("double").alias("label"),
        (F.col(toxic) if toxic in labels.columns else F.lit(None)).cast("double").alias("toxic_label"),
    ).where("label is not null or toxic_label is not null")
    truth = known.groupBy("key").agg(F.avg("label").alias("label"), F.avg("toxic_label").alias("toxic_label"))
    rows = written(measured.join(sent_if_few(truth), "key", "left"))
    worded, tells = word_evidence(rows, "toxic_label")
    judged = document_evidence(written(worded))
    judged = document_evidence(judged, "toxic_label", "word_measures", len(WORD_MEASURES), "toxic_own")
    judged = written(judged.drop("measures", "word_measures"))
    judged = _shrunk_by_site(judged, "label", "own", soft)
    judged = _shrunk_by_site(judged, "toxic_label", "toxic_own", soft, "toxic_")
    return judged.select(
        F.col("key").alias(key), "host", "path", "own", "host_rate", "path_rate", "posterior",
        (F.col("posterior") >= threshold).alias("keep"),
        "toxic_own", "toxic_host_rate", "toxic_path_rate", "toxic_posterior",
        ((F.col("toxic_posterior") >= toxic_threshold) & F.lit(tells)).alias("toxic"),
        *[F.col(f"carried{i}").alias(c) for i, c in enumerate(carried)],
    )


def keep_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``df`` without the rows that :func:`score_quality` rejects or finds toxic."""
    mark = free_name(df, "_digest")
    marked = df.withColumn(mark, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    scored = score_quality(marked, labels, key, text, carried=[mark], **settings)
    rejected = sent_if_few(
        scored.where("not keep or toxic").select(F.col(f"`{key}`").alias("_k"), F.col(mark).alias("_m")).distinct()
    )
    same = marked[key].eqNullSafe(rejected["_k"]) & (marked[mark] == rejected["_m"])
    return marked.join(rejected, same, "left_anti").drop(mark)
