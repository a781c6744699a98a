"""Every query against its SQL, and the driver's contract."""

import pytest

from tideline import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(name, same):
    same(q.QUERIES[name], q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_utf16_hash_is_python_s(spark, sf):
    import hashlib

    for r in q.QUERIES["row_hash_utf16_upper"](spark, sf).join(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey").limit(20).collect():
        assert r["row_hash"] == hashlib.sha256(f"{r['o_orderkey']}||{r['o_orderpriority']}".encode("utf-16-le")).hexdigest().upper()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["added", "changed", "matched", "deleted", "source_rows"]
    assert set(e.oracle_sql()) <= set(e.queries())
