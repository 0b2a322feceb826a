"""Sources, keys, joins, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.functions.expressions import entity_key, with_cyclical
from tallyguard.operators import folds
from tallyguard.operators.ordering import exact_medians, global_row_number
from tallyguard.operators.preprocess import column_kinds, metadata_columns
from tallyguard.operators.split import split_audit, temporal_split
from tallyguard.operators.windows import entity_position
from tallyguard.plans.views import (
    SPLIT,
    TXN,
    order_times,
    query,
    r6,
    scratch,
    split_transactions,
    table,
    transactions,
)
from tallyguard.reports.tables import first_rows
from tallyguard.sources import files, ingest


@query(
    f"""WITH {SPLIT}
SELECT split, count(*)::BIGINT AS n_rows, sum(isFraud)::BIGINT AS n_pos, round(avg(isFraud), 6) AS pos_rate,
       min(TransactionDT) AS min_time, max(TransactionDT) AS max_time
FROM parts GROUP BY split"""
)
def temporal_split_counts(spark, folder):
    audit = split_audit(split_transactions(spark, folder), "TransactionDT", "isFraud")
    return audit.withColumn("pos_rate", r6("pos_rate"))


@query(
    """WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS t,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, t, CASE WHEN rn <= floor(n * 0.98::DOUBLE) THEN 'train'
  WHEN rn <= floor(n * 0.98::DOUBLE) + floor(n * 0.01::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM o"""
)
def split_with_ties(spark, folder):
    """Many orders share a day, so the cuts fall inside ties and the id decides."""
    rows = order_times(spark, folder).select("o_orderkey", "t")
    return temporal_split(rows, "t", "o_orderkey", 0.98, 0.01, 0.01)


@query(
    """SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS t,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders"""
)
def global_row_rank(spark, folder):
    return global_row_number(order_times(spark, folder).select("o_orderkey", "t"), "t", "o_orderkey")


@query(
    f"""WITH {SPLIT}
SELECT split, count(DISTINCT card1)::BIGINT AS entities, count(DISTINCT ProductCD)::BIGINT AS products
FROM parts GROUP BY split"""
)
def distinct_entities(spark, folder):
    return (
        split_transactions(spark, folder)
        .groupBy("split")
        .agg(
            F.count_distinct("card1").alias("entities"),
            F.count_distinct("ProductCD").alias("products"),
        )
    )


@query(
    f"""WITH {TXN}, a AS (SELECT TransactionID, TransactionDT % 86400 / 3600.0::DOUBLE * (2 * pi() / 24) AS h,
  (TransactionDT / 86400.0::DOUBLE) % 7 * (2 * pi() / 7) AS d FROM txn)
SELECT TransactionID, round(sin(h), 6) + 0.0 AS hour_sin, round(cos(h), 6) + 0.0 AS hour_cos,
  round(sin(d), 6) + 0.0 AS day_sin, round(cos(d), 6) + 0.0 AS day_cos FROM a"""
)
def cyclical_features(spark, folder):
    rows = with_cyclical(transactions(spark, folder), "TransactionDT")
    return rows.select(
        "TransactionID", *[r6(c).alias(c) for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")]
    )


KEY_PARTS = """
  SELECT o_orderkey, c_custkey AS card1, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS card2,
         CASE WHEN o_totalprice >= 100000 THEN floor(o_totalprice) END AS card3,
         nullif(c_mktsegment, 'BUILDING') AS card4,
         CASE WHEN c_nationkey > 2 THEN c_nationkey END AS addr1, o_totalprice AS D1
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def _key_parts(spark, folder):
    joined = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    price = F.col("o_totalprice")
    return joined.select(
        "o_orderkey",
        F.col("c_custkey").alias("card1"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("card2"),
        F.when(price >= 100000, F.floor(price).cast("double")).alias("card3"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("card4"),
        F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("addr1"),
        price.alias("D1"),
    )


@query(
    f"""WITH k AS ({KEY_PARTS})
SELECT o_orderkey, concat_ws('_', coalesce(card1, 0)::VARCHAR, coalesce(card2, 0.0)::DOUBLE::VARCHAR,
  coalesce(card3, 0.0)::DOUBLE::VARCHAR, coalesce(card4, 'UNK'), coalesce(addr1, 0)::VARCHAR,
  coalesce(D1, 0.0)::DOUBLE::VARCHAR) AS card_id FROM k"""
)
def composite_entity_key(spark, folder):
    rows = _key_parts(spark, folder)
    return rows.select("o_orderkey", entity_key(rows, list(ingest.ENTITY_PARTS)).alias("card_id"))


@query(
    """SELECT o_orderkey, o_custkey::VARCHAR AS by_card, 'entity_0' AS by_nothing FROM orders"""
)
def entity_fallback(spark, folder):
    """Without the last key part the first card column is the entity; without both a constant."""
    orders = table(spark, folder, "orders")
    by_card = ingest.with_entity(
        orders.select("o_orderkey", F.col("o_custkey").alias("card1")), name="by_card"
    )
    return ingest.with_entity(by_card.drop("card1"), name="by_nothing")


@query(
    """SELECT d.doc_id AS TransactionID, d.lang, d.source, d.n_chars, l.quality, l.toxic,
  CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END AS source_right
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def left_join_identity(spark, folder):
    """Sparse right side; its clashing column is renamed."""
    left = table(spark, folder, "documents").select(
        F.col("doc_id").alias("TransactionID"), "lang", "source", "n_chars"
    )
    right = table(spark, folder, "labels").select(
        F.col("doc_id").alias("TransactionID"), "quality", "toxic", F.lit("labelled").alias("source")
    )
    return ingest.join_identity(left, right)


@query(
    """SELECT c.c_custkey AS TransactionID, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey"""
)
def left_join_duplicates(spark, folder):
    """Repeated right keys multiply rows; customers without orders stay."""
    left = table(spark, folder, "customer").select(F.col("c_custkey").alias("TransactionID"))
    right = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("TransactionID"), "o_orderkey", "o_totalprice"
    )
    return ingest.join_identity(left, right)


@query(
    """SELECT event_id, user_id::INT AS user_key, value::FLOAT::DOUBLE AS value,
  event_id::BIGINT AS paid, (event_id * 2)::INT AS twice FROM events"""
)
def downcast_types(spark, folder):
    """Doubles become floats; names with ``id`` stay long, other longs become int."""
    rows = table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("user_key"),
        "value",
        F.col("event_id").alias("paid"),
        (F.col("event_id") * 2).alias("twice"),
    )
    return ingest.downcast(rows).withColumn("value", F.col("value").cast("double"))


EVENT_CSV = "TransactionID long, TransactionDT long, card1 long, TransactionAmt double, ProductCD string, C1 int, isFraud int, score double"


@query(f"WITH {TXN} SELECT * FROM txn")
def csv_scan(spark, folder):
    path = scratch(spark)
    files.write_csv(transactions(spark, folder), path)
    return files.read_csv(spark, path, EVENT_CSV)


@query(f"WITH {SPLIT} SELECT * FROM parts")
def split_table_roundtrip(spark, folder):
    """The three splits as one zstd Parquet table with a folder per split."""
    path = scratch(spark)
    files.write_parquet(split_transactions(spark, folder), path, ["split"])
    return files.read_parquet(spark, path)


@query(
    f"""WITH {TXN}
SELECT TransactionID, TransactionDT, card1, TransactionAmt::FLOAT::DOUBLE AS TransactionAmt, isFraud,
  card4, addr1, D1::FLOAT::DOUBLE AS D1, quality, toxic,
  concat_ws('_', card1::VARCHAR, coalesce(card2, 0)::VARCHAR, '150.0', card4,
            coalesce(addr1, 0)::VARCHAR, coalesce(D1, 0)::FLOAT::VARCHAR) AS card_id
FROM (SELECT *, C1 AS card2, coalesce(ProductCD, 'UNK') AS card4, C1 AS addr1,
        CASE WHEN TransactionID % 3 > 0 THEN (TransactionID % 7)::DOUBLE END AS D1 FROM txn) t
LEFT JOIN labels l ON t.TransactionID = l.doc_id"""
)
def ingest_merged(spark, folder):
    """CSV in, cast, identity joined, key built, written in time order, read back."""
    number = F.col("TransactionID")
    rows = transactions(spark, folder).select(
        "TransactionID",
        "TransactionDT",
        "card1",
        "TransactionAmt",
        "isFraud",
        F.col("C1").alias("card2"),
        F.lit(150.0).alias("card3"),
        F.col("ProductCD").alias("card4"),
        F.col("C1").alias("addr1"),
        F.when(number % 3 > 0, (number % 7).cast("double")).alias("D1"),
    )
    identity = table(spark, folder, "labels").withColumnRenamed("doc_id", "TransactionID")
    raw, side, out = scratch(spark), scratch(spark), scratch(spark)
    files.write_csv(rows, raw)
    files.write_csv(identity, side)
    merged = ingest.run_ingestion(
        spark, out, transaction_csv=(raw, rows.schema), identity_csv=(side, identity.schema)
    )
    return merged.select(
        "TransactionID",
        "TransactionDT",
        "card1",
        F.col("TransactionAmt").cast("double").alias("TransactionAmt"),
        "isFraud",
        "card4",
        "addr1",
        F.col("D1").cast("double").alias("D1"),
        "quality",
        "toxic",
        "card_id",
    )


@query(
    f"""WITH {TXN}
SELECT (row_number() OVER (ORDER BY TransactionID) - 1)::BIGINT AS TransactionID,
  (TransactionDT // 3600)::BIGINT AS step, 'C' || card1 AS nameOrig, isFraud,
  (TransactionDT // 3600)::BIGINT * 3600 AS TransactionDT, 'C' || card1 AS card_id FROM txn"""
)
def ingest_step_ledger(spark, folder):
    """A ledger without row ids: ids follow the file order, which here is the event order."""
    raw, out = scratch(spark), scratch(spark)
    ledger = transactions(spark, folder).select(
        F.expr("TransactionDT div 3600").alias("step"),
        F.concat(F.lit("C"), F.col("card1").cast("string")).alias("nameOrig"),
        "isFraud",
        F.col("TransactionID").alias("at"),
    )
    in_order = ledger.repartitionByRange("at").sortWithinPartitions("at").drop("at")
    files.write_csv(in_order, raw)
    read = files.read_csv(spark, raw, "step long, nameOrig string, isFraud int")
    written = ingest.ingest_ledger(read, out, seconds_per_step=3600)
    return written.select(
        "TransactionID", F.col("step").cast("long").alias("step"), "nameOrig", "isFraud", "TransactionDT", "card_id"
    )


@query(
    f"WITH {TXN} SELECT TransactionID, TransactionDT, NULL::DOUBLE AS card_id, isFraud FROM txn"
)
def metadata_and_target(spark, folder):
    """A metadata column that is absent comes back as null."""
    rows = transactions(spark, folder)
    return rows.select(
        *metadata_columns(rows, ["TransactionID", "TransactionDT", "card_id", "isFraud"])
    )


DOCUMENT_ROLES = {
    "text": "categorical",
    "lang": "categorical",
    "source": "categorical",
    "n_chars": "numeric",
    "quality": "numeric",
    "toxic": "numeric",
    "long_text": "numeric",
}


@query(
    "WITH d AS (SELECT *, n_chars > 1000 AS long_text FROM documents LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c})::BIGINT AS present, count(DISTINCT {c})::BIGINT AS distinct_values FROM d"
        for c, k in DOCUMENT_ROLES.items()
    )
)
def column_roles(spark, folder):
    """Numeric and categorical columns by type (a boolean counts as numeric) and how full they are."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    rows = docs.withColumn("long_text", F.col("n_chars") > 1000)
    numeric, categorical = column_kinds(rows, ["doc_id"])
    kinds = dict.fromkeys(numeric, "numeric") | dict.fromkeys(categorical, "categorical")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
            for c, k in kinds.items()
        ]
    )
    return (
        rows.select(F.inline(cells))
        .groupBy("column_name", "kind")
        .agg(F.count("value").alias("present"), F.count_distinct("value").alias("distinct_values"))
    )


@query(
    f"""WITH {SPLIT}
SELECT TransactionID, TransactionDT, score FROM parts WHERE split = 'dev'
ORDER BY TransactionDT, TransactionID LIMIT 2000"""
)
def first_dev_rows(spark, folder):
    dev = split_transactions(spark, folder).where(F.col("split") == "dev")
    return first_rows(dev, "TransactionDT", "TransactionID", 2000).select(
        "TransactionID", "TransactionDT", "score"
    )


@query(
    f"""WITH {TXN}
SELECT TransactionID, card1, (row_number() OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID) - 1)::INT
  AS position FROM txn"""
)
def entity_positions(spark, folder):
    rows = transactions(spark, folder).select("TransactionID", "TransactionDT", "card1")
    return entity_position(rows, "card1", "TransactionDT", "TransactionID").drop("TransactionDT")


@query(
    f"""WITH {TXN} SELECT median(TransactionAmt) AS amount, median(C1)::DOUBLE AS c1,
  median(TransactionDT)::DOUBLE AS moment FROM txn"""
)
def exact_column_medians(spark, folder):
    """Medians by selection; the one-row result is rebuilt from the found values."""
    rows = transactions(spark, folder)
    found = exact_medians(rows, ["TransactionAmt", "C1", "TransactionDT"])
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(found["TransactionAmt"]).alias("amount"),
        F.lit(found["C1"]).alias("c1"),
        F.lit(found["TransactionDT"]).alias("moment"),
    )


FOLDS = """
o AS (SELECT o_orderkey AS id, o_custkey AS entity, epoch(o_orderdate)::DOUBLE AS t FROM orders),
b AS (SELECT min(t) AS t0, max(t) AS t1, (1 - 0.4::DOUBLE) / 5 AS s FROM o),
f AS (SELECT i::INT AS fold, t0 + (0.4::DOUBLE + i * s) * (t1 - t0) AS vs,
             t0 + (0.4::DOUBLE + i * s + s) * (t1 - t0) AS ve FROM b, range(0, 5) r(i)),
val AS (SELECT fold, id, entity FROM o JOIN f ON t >= vs AND (t < ve OR (fold = 4 AND t <= ve))),
cand AS (SELECT fold, id, entity, t, vs FROM o JOIN f ON t < vs
         WHERE fold IN (SELECT DISTINCT fold FROM val)),
trn AS (SELECT fold, id FROM cand c WHERE t < vs - 86400 AND NOT EXISTS
        (SELECT 1 FROM val v WHERE v.fold = c.fold AND v.entity = c.entity))"""


@query(
    f"""WITH {FOLDS}
SELECT fold, 'validation' AS role, id FROM val UNION ALL SELECT fold, 'train', id FROM trn"""
)
def purged_cv_rows(spark, folder):
    return folds.purged_folds(order_times(spark, folder), "o_orderkey", "o_custkey", "t")


@query(
    f"""WITH {FOLDS}, c AS (SELECT fold, count(*) AS n FROM cand GROUP BY fold),
t AS (SELECT fold, count(*) AS n FROM trn GROUP BY fold), v AS (SELECT fold, count(*) AS n FROM val GROUP BY fold)
SELECT fold, coalesce(t.n, 0)::BIGINT AS train_rows, (coalesce(c.n, 0) - coalesce(t.n, 0))::BIGINT AS purged_rows,
  v.n::BIGINT AS validation_rows FROM v LEFT JOIN c USING (fold) LEFT JOIN t USING (fold)"""
)
def purged_cv_counts(spark, folder):
    return folds.fold_report(order_times(spark, folder), "o_orderkey", "o_custkey", "t")


@query(
    f"""WITH {
        FOLDS.replace(
            "epoch(o_orderdate)::DOUBLE AS t", "(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE AS t"
        )
    }
SELECT fold, 'validation' AS role, count(*)::BIGINT AS n, min(id) AS lo, max(id) AS hi FROM val GROUP BY fold
UNION ALL SELECT fold, 'train', count(*)::BIGINT, min(id), max(id) FROM trn GROUP BY fold""".replace(
        "86400", "100"
    )
)
def purged_cv_row_index(spark, folder):
    """Row position as time, for tables without a timestamp; the buffer is 100 rows."""
    rows = folds.with_row_time(
        order_times(spark, folder).select("o_orderkey", "o_custkey", "t"), "t", "o_orderkey"
    )
    settings = folds.PurgedFolds(purge_buffer_seconds=100.0)
    found = folds.purged_folds(rows, "o_orderkey", "o_custkey", "row_time", settings)
    return found.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
