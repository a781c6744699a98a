"""Configuration, cutoffs, names and partition arithmetic."""

from datetime import datetime

import pytest

from tideline.functions import naming as n
from tideline.operators import partitions as pt
from tideline.operators import predicates as p
from tideline.plans import config as c
from tideline.sources import tables as t


def test_all_problems_are_told_at_once():
    with pytest.raises(c.ConfigError) as e:
        c.parse({"dialect": "oracle", "settings": {"method": "hash", "nonsense": 1, "partition_by": {"mode": "hourly"}}})
    text = str(e.value)
    assert all(x in text for x in ("table is missing", "oracle", "needs a key", "nonsense", "hourly"))


def test_inert_keys_are_accepted():
    assert c.parse({"table": "t", "settings": {"num_parallel": 4, "force_reload": "ano"}}).settings.force_reload


@pytest.mark.parametrize(("settings", "method"), [({"method": "full", "resume_full_load": True, "key": "id"}, "id_watermark"), ({"method": "full", "resume_full_load": True, "force_reload": True}, "full"), ({"method": "hash_diff", "key": "id"}, "hash"), ({"method": "full_by_source", "force_reload": True}, "full_by_source"), ({"method": "incremental", "parent_table": "p"}, "parent_incremental")])
def test_method_resolution(settings, method):
    assert c.resolve_method(c.LoadSettings(**settings)) == method


def test_required_columns_survive_selection():
    s = c.LoadSettings(method="hash", key="ID", only_columns=("name",), exclude_columns=("id",))
    cols = ["id", "name", "x"]
    assert t.select_columns(cols, list(s.only_columns), list(s.exclude_columns), c.required_columns(s, cols)) == ["id", "name"]
    with pytest.raises(ValueError):
        t.select_columns(["a"], ["b"])


def test_redaction():
    text = c.redact("postgresql://u:secret@h/db password=hunter2 and token", ("token",))
    assert "secret" not in text and "hunter2" not in text and "token" not in text


def test_cutoffs():
    now = datetime(2026, 8, 16, 10)
    assert p.cutoff(now, lookback_hours=6) == datetime(2026, 8, 16) and p.cutoff(now, lookback_hours=24) == datetime(2026, 8, 15)
    assert p.cutoff(now) == p.cutoff(now, days_back=0) == p.cutoff(now, lookback_hours=0) == datetime(2026, 8, 2)
    assert p.cutoff_value(datetime(2026, 8, 16), "firebird") == 46250 and p.cutoff_value(now, "mysql") == "2026-08-16 10:00:00"
    assert p.cutoff(now, deep=True) == datetime(2026, 1, 1) and p.cutoff(datetime(2026, 6, 30), deep=True) == datetime(2025, 1, 1)


def test_literals_and_quotes():
    assert p.literal("a'b\\c", "mysql") == "'a''b\\\\c'" and p.literal("a\\") == "'a\\'" and p.literal(3) == "3"
    assert [p.quote("order", d) for d in ("mysql", "mssql", "postgres", "firebird")] == ["`order`", "[order]", '"order"', '"ORDER"']


def test_jdbc_options():
    o = t.jdbc_options("mssql", "jdbc:x", "t", "id", (1, 9), database="db")
    assert o["dbtable"] == "[db].[dbo].[t]" and o["partitionColumn"] == "[id]" and o["numPartitions"] == "16"


def test_names(spark):
    assert n.column_mapping_name(" Order  No. ") == "order_no"
    assert "SELECT" in n.sql_keywords(spark)
    with pytest.raises(ValueError):
        n.target_column_names(["a b", "a_b"], ())
    long = "x" * 80
    assert len(n.index_name(long, ["id"])) <= 63 and len(n.partition_name(long, "2026")) <= 63
    assert n.slug("Company A/B") == "company_a_b" and n.slug("!!") == "x"


@pytest.mark.parametrize(("mode", "day", "lo", "hi"), [("range_day", "2026-12-31", "2026-12-31", "2027-01-01"), ("range_month", "2026-12-31", "2026-12-01", "2027-01-01"), ("range_month", "2028-02-29", "2028-02-01", "2028-03-01"), ("range_year", "2026-08-14", "2026-01-01", "2027-01-01")])
def test_period_bounds(spark, mode, day, lo, hi):
    from pyspark.sql import functions as F

    a, b = pt.bounds(F.lit(day), mode)
    r = spark.range(1).select(a.cast("string"), b.cast("string")).first()
    assert tuple(r) == (lo, hi)


def test_partition_specs():
    assert pt.parse_spec("a") == pt.PartitionSpec("a") and pt.parse_spec(None, True) == pt.PartitionSpec("_source") and pt.parse_spec(None) is None
    spec = pt.parse_spec({"column": "d", "mode": "range_day"})
    assert pt.effective_spec(spec, False, None) == (spec, None) and pt.effective_spec(spec, True, None)[0] is None
    with pytest.raises(ValueError):
        pt.effective_spec(spec, True, "other")
    assert pt.unique_key(["id"], spec) == ["id", "d"]


def test_null_key_without_default_partition_fails(spark):
    df = spark.createDataFrame([(None,)], "d string")
    with pytest.raises(Exception, match="no partition"):
        pt.route(df, pt.PartitionSpec("d", "list", False)).collect()


def test_older_sections():
    got = c.parse({"TABLE": {"source_name": "src", "output_table": "dst", "excluded_columns": "x, y"}, "LOAD_SETTINGS": {"load_method": "incremental", "primary_column": "id", "incremental_date_column": "d", "incremental_date_column_fallback": "e", "incremental_lookback_hours": "0", "batch_size": 5, "pagination_mode": "keyset"}, "DIALECT": "mysql", "DATABASES": [{"name": "one"}], "EMPTY_ROWS_OK": "ano"})
    s = got.settings
    assert (got.table, got.target, got.dialect, got.sources) == ("src", "dst", "mysql", ("one",))
    assert (s.method, s.key, s.date_column, s.created_column, s.exclude_columns, s.empty_rows_ok, s.deep_window) == ("incremental", "id", "d", "e", ("x", "y"), True, True)
    p = c.parse({"TABLE_NAME": "kids", "DIALECT": "firebird", "LOAD_SETTINGS": {"load_method": "incremental", "primary_key_column": "id", "incremental_parent_table": "p", "incremental_parent_key_column": "pid", "incremental_parent_date_column": "m"}}).settings
    assert (c.resolve_method(p), p.foreign_key, p.parent_key, p.parent_dates) == ("parent_incremental", "pid", "id", ("m",))


@pytest.mark.parametrize(("dialect", "method", "ok"), [("firebird", "hash", False), ("mysql", "full_by_source", False), ("mssql", "full_by_source", True), ("mysql", "parent_incremental", False), ("firebird", "id_watermark", True)])
def test_gates(dialect, method, ok):
    raw = {"table": "t", "dialect": dialect, "settings": {"method": method, "key": "id", "parent_table": "p", "parent_key": "id", "foreign_key": "f", "parent_dates": "d"}}
    if ok:
        c.parse(raw)
    else:
        with pytest.raises(c.ConfigError, match="does not support"):
            c.parse(raw)


def test_retries():
    calls, pauses = [], []

    def work(message, good):
        calls.append(1)
        if len(calls) < good:
            raise OSError(message)
        return "done"

    assert c.retried(lambda: work("connection reset", 3), pause=pauses.append) == "done" and pauses == [5.0, 10.0]
    calls.clear()
    with pytest.raises(OSError):
        c.retried(lambda: work("no such table", 3), pause=pauses.append)
    assert len(calls) == 1
    calls.clear()
    with pytest.raises(OSError):
        c.retried(lambda: work("timed out", 99), attempts=4, pause=pauses.append)
    assert len(calls) == 4


def test_reads_and_targets():
    from tideline.plans.run import progress

    assert t.select_sql("[t]", {"id": "int", "n": "NVARCHAR"}, "mssql", "id > 1", "id", True) == "SELECT [id], CONVERT(VARCHAR(MAX), [n]) AS [n] FROM [t] WHERE (id > 1) ORDER BY [id]"
    assert t.column_sql("n", "nvarchar", "mssql") == "[n]" and t.column_sql("n", "varchar", "mssql", True) == "[n]"
    assert [t.batch_rows(100), t.batch_rows(100_000), t.batch_rows(10**9), t.batch_rows(10, 500)] == [10_000, 4000, 1000, 500]
    assert c.resolve_target(("variable", None), ("profile", "b"), ("other", "c")) == "b"
    with pytest.raises(c.ConfigError, match="variable, profile"):
        c.resolve_target(("variable", ""), ("profile", None))
    assert progress(1, 4, 10.0) == "1 of 4 (25 %), 30 s left" and progress(4, 4, 1) == "4 of 4 (100 %)"
