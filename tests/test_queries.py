"""Every registered query runs, and equals its SQL twin where it has one."""

import __spark_entry__ as contract
import pytest
from compare import differences, oracle

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    found = QUERIES[name](spark, folder)
    rows = found.collect()
    spark.catalog.clearCache()
    if name not in SQL:
        assert rows
        return
    result = oracle(folder).execute(SQL[name])
    names = [d[0] for d in result.description]
    assert differences(rows, found.columns, result.fetchall(), names) is None


def test_entry(spark):
    found = contract.entry(spark)
    assert found.count() == 1
    assert "pr_auc" in found.columns


def test_names_are_covered():
    assert set(SQL) <= set(QUERIES)
