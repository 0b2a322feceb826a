"""Compare a query with its SQL twin: names, row count and values, whatever the row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def oracle(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, int):
        return float(value)
    number = float(value)
    return "nan" if math.isnan(number) else number


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_rows, spark_names, sql_rows, sql_names) -> str | None:
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(spark_names)} against {sorted(sql_names)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows against {len(sql_rows)}"
    left, right = rows_of(spark_names, spark_rows), rows_of(sql_names, sql_rows)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, such as {wrong[:2]}" if wrong else None
