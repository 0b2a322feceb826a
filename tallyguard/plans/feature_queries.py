"""Fitted features, correlation, latent features and lookback windows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyguard.operators import latent, windows
from tallyguard.operators.correlation import correlation_matrix as pearson
from tallyguard.operators.correlation import redundant_columns
from tallyguard.operators.preprocess import fit_features, transform_features
from tallyguard.operators.split import temporal_split
from tallyguard.plans.views import SPLIT, TXN, query, r6, scratch, split_transactions, table, transactions
from tallyguard.reports import tables
from tallyguard.sources import files

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "disc_qty", "flat"]

LINES = """
v AS (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_tax > 0 THEN l_tax END AS l_tax,
  l_extendedprice * (1 - l_discount) AS net, l_discount * l_quantity AS disc_qty, 7.0::DOUBLE AS flat FROM lineitem)"""


def _lines(spark, folder):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, folder, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"),
        (price * (1 - discount)).alias("net"),
        (discount * F.col("l_quantity")).alias("disc_qty"),
        F.lit(7.0).alias("flat"),
    )


def _corr_sql(columns: list[str]) -> str:
    rows = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            value = "CASE WHEN count(*) < 0 THEN 0.0::DOUBLE END" if "flat" in (a, b) else f"round(corr({a}, {b}), 6) + 0.0"
            rows.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col_i, '{b}' AS col_j, {value} AS corr FROM v")
    return " UNION ALL ".join(rows)


@query(f"WITH {LINES} {_corr_sql(LINE_COLUMNS)}")
def correlation_matrix(spark, folder):
    """Nulls are left out pair by pair; the constant column has no correlation."""
    return pearson(_lines(spark, folder), LINE_COLUMNS).withColumn("corr", r6("corr"))


@query(
    f"""WITH {LINES}, m AS ({_corr_sql(LINE_COLUMNS)}),
c AS (SELECT unnest({LINE_COLUMNS!r}) AS column_name)
SELECT column_name, column_name NOT IN (SELECT col_j FROM m WHERE abs(corr) > 0.9) AS kept FROM c"""
)
def correlation_filter(spark, folder):
    rows = _lines(spark, folder)
    dropped = redundant_columns(rows, LINE_COLUMNS)
    verdicts = [F.struct(F.lit(c).alias("column_name"), F.lit(c not in dropped).alias("kept")) for c in LINE_COLUMNS]
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*verdicts)))


@query(
    """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.k::INT AS i, b.k::INT AS j, round(corr(a.x, b.x), 6) + 0.0 AS corr
FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY 1, 2"""
)
def correlation_wide(spark, folder):
    """64 columns: pair sums as matrices per task."""
    rows = table(spark, folder, "embeddings").select(
        *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)]
    )
    return pearson(rows, rows.columns).select("i", "j", r6("corr").alias("corr"))


FEATURES = f"""{SPLIT},
wide AS (SELECT *, TransactionAmt * 2 + 1 AS twice, CASE WHEN card1 % 5 > 0 THEN ProductCD END AS kind,
  CASE WHEN split = 'train' THEN 'known' ELSE ProductCD END AS late FROM parts),
trn AS (SELECT * FROM wide WHERE split = 'train'),
med AS (SELECT median(TransactionAmt) AS m_amt, median(C1)::DOUBLE AS m_c1 FROM trn),
st AS (SELECT avg(TransactionAmt) AS a_amt, stddev_pop(TransactionAmt) AS s_amt,
  avg(coalesce(C1, m_c1)) AS a_c1, stddev_pop(coalesce(C1, m_c1)) AS s_c1 FROM trn, med GROUP BY m_amt, m_c1),
codes AS (SELECT c, row_number() OVER (ORDER BY c) AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT coalesce(kind, 'MISSING') AS c FROM trn))"""


def _feature_rows(spark, folder):
    rows = split_transactions(spark, folder)
    return rows.select(
        "TransactionID",
        "TransactionDT",
        F.col("card1").alias("card_id"),
        "isFraud",
        "split",
        "TransactionAmt",
        "C1",
        (F.col("TransactionAmt") * 2 + 1).alias("twice"),
        F.when(F.col("card1") % 5 > 0, F.col("ProductCD")).alias("kind"),
        F.when(F.col("split") == "train", "known").otherwise(F.col("ProductCD")).alias("late"),
    )


@query(
    f"""WITH {FEATURES}
SELECT TransactionID, split, round((TransactionAmt - a_amt) / s_amt, 6) + 0.0 AS num_TransactionAmt,
  round((coalesce(C1, m_c1) - a_c1) / s_c1, 6) + 0.0 AS num_C1,
  round(coalesce(k, 0) / (SELECT max(n) + 1.0 FROM codes), 6) + 0.0 AS cat_kind,
  CASE WHEN late = 'known' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS cat_late
FROM wide, med, st LEFT JOIN codes ON c = coalesce(kind, 'MISSING')"""
)
def feature_matrix(spark, folder):
    """Fit on train, apply to all splits: one column is pruned, one has only unseen values later."""
    path = scratch(spark)
    files.write_parquet(_feature_rows(spark, folder), path, ["split"])
    # Fitting passes over the train folder alone.
    rows = spark.read.parquet(path)
    state = fit_features(rows.where(F.col("split") == "train").drop("split"))
    found = transform_features(rows, state)
    if state.correlated != ["twice"]:
        raise AssertionError(f"pruned {state.correlated}")
    return found.select(
        "TransactionID",
        "split",
        r6("num_TransactionAmt").alias("num_TransactionAmt"),
        r6("num_C1").alias("num_C1"),
        r6("cat_kind").alias("cat_kind"),
        r6("cat_late").alias("cat_late"),
    )


@query(
    """WITH d AS (SELECT doc_id, quality::DOUBLE AS quality, n_chars::DOUBLE AS n_chars FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.8::DOUBLE) AS train FROM d),
m AS (SELECT median(quality) AS mq, median(n_chars) AS mn FROM r WHERE train),
s AS (SELECT avg(coalesce(quality, mq)) AS aq, stddev_pop(coalesce(quality, mq)) AS sq,
  avg(n_chars) AS an, stddev_pop(n_chars) AS sn FROM r, m WHERE train)
SELECT doc_id, round((coalesce(quality, mq) - aq) / CASE WHEN sq = 0 THEN 1 ELSE sq END, 6) + 0.0 AS num_quality,
  round((n_chars - an) / sn, 6) + 0.0 AS num_n_chars FROM r, m, s"""
)
def median_impute_scale(spark, folder):
    """Most documents have no label, so most values are imputed."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.withColumn("at", F.col("doc_id"))
    parts = temporal_split(rows, "at", "doc_id")
    state = fit_features(parts.where(F.col("split") == "train"), "none", "at", "none", "doc_id")
    found = transform_features(parts, state)
    return found.select("doc_id", r6("num_quality").alias("num_quality"), r6("num_n_chars").alias("num_n_chars"))


CODES = """WITH d AS (SELECT doc_id, source || '/' || lang AS place FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.8::DOUBLE) AS train FROM d),
k AS (SELECT place, row_number() OVER (ORDER BY place) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT place FROM r WHERE train))
SELECT doc_id, round(coalesce(k, 0) / (SELECT max(n) + 1.0 FROM k), 6) AS cat_place FROM r LEFT JOIN k USING (place)"""


def _codes(spark, folder, inline):
    rows = table(spark, folder, "documents").select(
        "doc_id", F.col("doc_id").alias("at"), F.concat_ws("/", "source", "lang").alias("place")
    )
    parts = temporal_split(rows, "at", "doc_id")
    train = parts.where(F.col("split") == "train")
    state = fit_features(train, "none", "at", "none", "doc_id", inline_categories=inline)
    return transform_features(parts, state).select("doc_id", r6("cat_place").alias("cat_place"))


@query(CODES)
def ordinal_encode(spark, folder):
    return _codes(spark, folder, 256)


@query(CODES)
def ordinal_encode_dictionary(spark, folder):
    """The same codes through a dictionary table, as used for many categories."""
    return _codes(spark, folder, 10)


# Closed form for two standardised columns: the components are (1, 1) and (1, -1) over sqrt 2.
PAIR = """
z AS (SELECT l_orderkey, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS a,
  (l_extendedprice * (1 - l_discount) - avg(l_extendedprice * (1 - l_discount)) OVER ())
    / stddev_pop(l_extendedprice * (1 - l_discount)) OVER () AS b FROM lineitem)"""


def _pair(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    )
    names = ("l_extendedprice", "net")
    stats = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.stddev_pop)]).first()
    scaled = [
        ((F.col(c) - F.lit(stats[f"avg_{c}"])) / F.lit(stats[f"stddev_pop_{c}"])).alias(f"z_{c}") for c in names
    ]
    return latent.assemble(rows.select("l_orderkey", *scaled), [f"z_{c}" for c in names])


@query(
    f"""WITH {PAIR} SELECT l_orderkey, round((a + b) / sqrt(2), 5) + 0.0 AS pc1, round(abs(a - b) / sqrt(2), 5) + 0.0 AS pc2_size FROM z"""
)
def pca_projection(spark, folder):
    """Checked against the closed form for two standardised columns."""
    rows = _pair(spark, folder)
    fitted = latent.fit_pca(rows)
    found = latent.with_projection(rows, fitted)
    return found.select(
        "l_orderkey", r6(F.get("latent", 0), 5).alias("pc1"), r6(F.abs(F.get("latent", 1)), 5).alias("pc2_size")
    )


@query(
    f"""WITH {PAIR}, r AS (SELECT corr(a, b) AS r FROM z)
SELECT 1 AS component, round((1 + r) / 2, 6) AS variance_ratio, round((1 + r) / 2, 6) AS cumulative_ratio, (1 + r) / 2 <= 0.9 AS within_target FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0, false FROM r"""
)
def pca_scree(spark, folder):
    found = latent.scree_table(spark, latent.fit_pca(_pair(spark, folder)))
    return found.withColumns(
        {"variance_ratio": r6("variance_ratio"), "cumulative_ratio": r6("cumulative_ratio")}
    )


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )


@query()
def pca_embedding_coordinates(spark, folder):
    """Three coordinates of every vector, with the number of components kept."""
    rows = latent.as_vector(_vectors(spark, folder), "embedding")
    fitted = latent.fit_pca(rows)
    found = latent.with_projection(rows, fitted)
    return found.select(
        "vec_id",
        *[r6(F.get("latent", i)).alias(f"PCA_{i + 1}") for i in range(3)],
        F.lit(fitted.k).alias("components"),
    )


@query()
def kmeans_clusters(spark, folder):
    """Cluster of every vector on its principal components."""
    rows = latent.as_vector(_vectors(spark, folder), "embedding")
    points = latent.with_projection(rows, latent.fit_pca(rows, n_components=8)).select("vec_id", "label", "latent")
    centroids = latent.fit_kmeans(points, "latent", 8)
    near = points.withColumn("distances", latent.centroid_distances(F.col("latent"), centroids))
    return near.select("vec_id", "label", latent.nearest("distances").alias("cluster"))


@query(
    """SELECT count(*)::BIGINT AS vectors, 64 AS dimensions, true AS at_least_three, true AS falling,
  true AS shares_of_total, true AS orthonormal, 0::DOUBLE AS mean_1, 0::DOUBLE AS mean_2 FROM embeddings"""
)
def pca_contract(spark, folder):
    """Loadings are orthonormal, shares fall and stay within the total, projections are centred."""
    rows = latent.as_vector(_vectors(spark, folder), "embedding")
    fitted = latent.fit_pca(rows)
    loadings = np.array(fitted.components, float)
    loadings = loadings if loadings.shape[0] <= loadings.shape[1] else loadings.T
    identity = np.eye(len(loadings))
    checks = {
        "at_least_three": fitted.k >= 3,
        "falling": all(a >= b - 1e-12 for a, b in zip(fitted.ratios, fitted.ratios[1:])),
        "shares_of_total": 0 < sum(fitted.ratios) <= 1 + 1e-9,
        "orthonormal": bool(np.allclose(loadings @ loadings.T, identity, atol=1e-8)),
    }
    return latent.with_projection(rows, fitted).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.lit(loadings.shape[1]).alias("dimensions"),
        *[F.lit(bool(v)).alias(k) for k, v in checks.items()],
        *[r6(F.avg(F.get("latent", i))).alias(f"mean_{i + 1}") for i in range(2)],
    )


@query(
    """SELECT count(*)::BIGINT AS vectors, 8 AS clusters, count(*)::BIGINT AS at_nearest,
  count(DISTINCT vec_id)::BIGINT AS ids FROM embeddings"""
)
def kmeans_contract(spark, folder):
    """Every vector belongs to one cluster, that of its nearest centroid; no cluster is empty."""
    rows = latent.as_vector(_vectors(spark, folder), "embedding")
    points = latent.with_projection(rows, latent.fit_pca(rows, n_components=8)).select("vec_id", "latent")
    centroids = latent.fit_kmeans(points, "latent", 8)
    near = points.withColumn("d", latent.centroid_distances(F.col("latent"), centroids))
    near = near.withColumn("cluster", latent.nearest("d"))
    return near.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_distinct("cluster").cast("int").alias("clusters"),
        F.count_if(F.get("d", F.col("cluster").cast("int")) == F.array_min("d")).alias("at_nearest"),
        F.count_distinct("vec_id").alias("ids"),
    )


DISTANCES = """
e AS (SELECT vec_id, label, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label AS centre, k, avg(x) AS m FROM e GROUP BY 1, 2),
n AS (SELECT centre, row_number() OVER (ORDER BY centre) - 1 AS num FROM (SELECT DISTINCT centre FROM c)),
d AS (SELECT vec_id, label, num, sqrt(sum((x - m) * (x - m))) AS dist
      FROM e JOIN c USING (k) JOIN n USING (centre) GROUP BY 1, 2, 3)"""


def _distances(spark, folder):
    rows = _vectors(spark, folder)
    # One row per label: ten labels whatever the table size.
    centres = latent.label_centroids(rows, "embedding", "label").orderBy("label").collect()
    centroids = [list(r["centroid"]) for r in centres]
    return rows.withColumn("distances", latent.centroid_distances(F.col("embedding"), centroids))


@query(f"WITH {DISTANCES} SELECT vec_id, num::INT AS centroid, round(dist, 6) AS distance FROM d")
def centroid_distances(spark, folder):
    found = _distances(spark, folder)
    return found.select("vec_id", F.posexplode("distances").alias("centroid", "distance")).withColumn(
        "distance", r6("distance")
    )


@query(f"WITH {DISTANCES} SELECT vec_id, arg_min(num, (dist, num))::INT AS cluster FROM d GROUP BY vec_id")
def nearest_centroid(spark, folder):
    return _distances(spark, folder).select("vec_id", latent.nearest("distances").cast("int").alias("cluster"))


@query(
    f"""WITH {DISTANCES} SELECT vec_id, k::INT AS pos, round(x, 6) + 0.0 AS value FROM e
UNION ALL SELECT vec_id, (64 + num)::INT, round(dist, 6) FROM d"""
)
def feature_augmentation(spark, folder):
    rows = latent.as_vector(_distances(spark, folder), "embedding")
    both = latent.augment(rows, "features", "distances")
    values = vector_to_array("features_augmented")
    return both.select("vec_id", F.posexplode(values).alias("pos", "value")).withColumn("value", r6("value"))


def _points(spark, folder):
    rows = _distances(spark, folder).withColumn("cluster", latent.nearest("distances"))
    flagged = rows.withColumn("flag", (F.col("label") == 3).cast("int"))
    return tables.latent_points(flagged, "embedding", "flag", "cluster", "vec_id")


@query(
    f"""WITH {DISTANCES}, a AS (SELECT vec_id, arg_min(num, (dist, num)) AS cluster FROM d GROUP BY vec_id)
SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS "PCA_1", round(embedding[2]::DOUBLE, 6) + 0.0 AS "PCA_2",
  round(embedding[3]::DOUBLE, 6) + 0.0 AS "PCA_3",
  CASE WHEN label = 3 THEN 'Fraud (1)' ELSE 'Legitimate (0)' END AS "isFraud", 'Cluster ' || cluster AS "Cluster"
FROM embeddings JOIN a USING (vec_id)"""
)
def latent_points(spark, folder):
    found = _points(spark, folder)
    return found.withColumns({f"PCA_{i}": r6(f"PCA_{i}") for i in (1, 2, 3)})


@query(
    f"""WITH {DISTANCES}, a AS (SELECT vec_id, label, arg_min(num, (dist, num)) AS cluster FROM d GROUP BY vec_id, label)
SELECT 'Cluster ' || cluster AS "Cluster", CASE WHEN label = 3 THEN 'Fraud (1)' ELSE 'Legitimate (0)' END AS "isFraud",
  count(*)::BIGINT AS n FROM a GROUP BY 1, 2"""
)
def cluster_profile(spark, folder):
    return tables.cluster_profile(_points(spark, folder))


def _ids(history: str = "history"):
    return F.array_join(F.transform(history, lambda h: h["TransactionID"].cast("string")), ",")


def _lookback_sql(entity: str = "card1", group: str = "", length: int = 10, floor: int = 1) -> str:
    return f"""WITH {SPLIT}, k AS (SELECT *, {entity} AS entity FROM parts),
w AS (SELECT TransactionID, split, list(TransactionID) OVER (
  PARTITION BY entity, CASE WHEN entity IS NULL THEN TransactionID END {group} ORDER BY TransactionDT, TransactionID
  ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS h FROM k)
SELECT TransactionID, split, CASE WHEN len(h) < {floor} THEN TransactionID::VARCHAR ELSE array_to_string(h, ',') END AS history
FROM w"""


def _lookback(spark, folder, entity="card1", **settings):
    rows = split_transactions(spark, folder)
    if entity != "card1":
        rows = rows.withColumn("entity", F.expr(entity))
        entity = "entity"
    found = windows.lookback_windows(
        rows, entity, "TransactionDT", "TransactionID", ["TransactionID"], **settings
    )
    return found.select("TransactionID", "split", _ids().alias("history"))


@query(_lookback_sql())
def lookback_windows(spark, folder):
    return _lookback(spark, folder)


@query(_lookback_sql(group=", split"))
def lookback_within_split(spark, folder):
    return _lookback(spark, folder, cross_split=False)


@query(_lookback_sql(entity="nullif(card1, 3)"))
def lookback_null_entity(spark, folder):
    return _lookback(spark, folder, entity="nullif(card1, 3)")


@query(_lookback_sql(floor=5))
def lookback_min_history(spark, folder):
    return _lookback(spark, folder, min_history=5)


@query(_lookback_sql(entity="CASE WHEN card1 % 3 = 0 THEN 0 ELSE card1 END", length=20))
def lookback_hot_entity(spark, folder):
    """A third of the rows share one entity, which is cut into time ranges."""
    return _lookback(spark, folder, entity="CASE WHEN card1 % 3 = 0 THEN 0 ELSE card1 END", length=20, hot_rows=200)


@query(
    f"""WITH {SPLIT}, w AS (SELECT TransactionID, split, list(TransactionAmt) OVER o AS a, list(score) OVER o AS s FROM parts
  WINDOW o AS (PARTITION BY card1 ORDER BY TransactionDT, TransactionID ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT TransactionID, split,
  array_to_string(list_concat([0.0::DOUBLE FOR i IN range(0, 10 - len(a))], a), ',') AS amounts,
  array_to_string(list_concat([0.0::DOUBLE FOR i IN range(0, 10 - len(s))], s), ',') AS scores,
  array_to_string(list_concat([1 FOR i IN range(0, 10 - len(a))], [0 FOR i IN range(0, len(a))]), '') AS mask FROM w"""
)
def lookback_padding(spark, folder):
    """Fixed-length windows: zeros in front and a mask that marks them."""
    names = ["TransactionAmt", "score"]
    rows = windows.lookback_windows(
        split_transactions(spark, folder), "card1", "TransactionDT", "TransactionID", names
    )
    padded = windows.pad_windows(rows, names)

    def step(i):
        return F.array_join(F.transform("window", lambda v: v[i].cast("string")), ",")

    mask = F.array_join(F.transform("padding_mask", lambda m: m.cast("int").cast("string")), "")
    return padded.select(
        "TransactionID", "split", step(0).alias("amounts"), step(1).alias("scores"), mask.alias("mask")
    )


@query(
    f"""WITH {TXN}, r AS (SELECT *, coalesce(C1, 0) / 3.0::DOUBLE AS e,
  row_number() OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID) AS pos FROM txn),
j AS (SELECT a.TransactionID, b.e, b.TransactionAmt AS x, b.score AS s, max(b.e) OVER (PARTITION BY a.TransactionID) AS top
  FROM r a JOIN r b ON a.card1 = b.card1 AND b.pos BETWEEN a.pos - 9 AND a.pos)
SELECT TransactionID, round(sum(exp(e - top) * x) / sum(exp(e - top)) / (1 + 1e-8), 5) AS amount,
  round(sum(exp(e - top) * s) / sum(exp(e - top)) / (1 + 1e-8), 5) AS score FROM j GROUP BY TransactionID"""
)
def masked_pooling(spark, folder):
    """Softmax pooling of each window with an energy per step; padding has no influence."""
    rows = transactions(spark, folder).withColumn("energy", F.coalesce(F.col("C1"), F.lit(0)) / 3.0)
    names = ["energy", "TransactionAmt", "score"]
    padded = windows.pad_windows(
        windows.lookback_windows(rows, "card1", "TransactionDT", "TransactionID", names), names
    )
    energies = F.transform("window", lambda v: v[0])
    values = F.transform("window", lambda v: F.slice(v, 2, 2))
    pooled = windows.masked_pooling(energies, values, F.col("padding_mask"))
    return padded.select("TransactionID", pooled.alias("pooled")).select(
        "TransactionID", r6(F.get("pooled", 0), 5).alias("amount"), r6(F.get("pooled", 1), 5).alias("score")
    )


@query(
    f"""WITH {SPLIT}, w AS (SELECT TransactionID, split, count(*) OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n,
  count(*) FILTER (split <> 'train') OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS later FROM parts)
SELECT split, count(*)::BIGINT AS targets, sum(n)::BIGINT AS steps, sum(later)::BIGINT AS later_steps FROM w GROUP BY split"""
)
def lookback_cross_split(spark, folder):
    """Dev and test windows reach back into earlier splits; train windows never see later rows."""
    found = windows.lookback_windows(
        split_transactions(spark, folder), "card1", "TransactionDT", "TransactionID", ["TransactionID", "split"]
    )
    later = F.size(F.filter("history", lambda h: h["split"] != "train"))
    return found.groupBy("split").agg(
        F.count(F.lit(1)).alias("targets"),
        F.sum(F.size("history")).alias("steps"),
        F.sum(later).alias("later_steps"),
    )
