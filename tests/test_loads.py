"""Load methods, runs and the versioned store."""

from datetime import datetime

import pytest

from tideline.functions.hashing import row_hash
from tideline.operators import diff as d
from tideline.operators import merge as m
from tideline.plans import strategies as st
from tideline.plans.config import LoadSettings
from tideline.plans.run import SourceError, run
from tideline.sources.store import TargetStore

NOW, AT = "2026-08-16T00:00:00Z", datetime(2026, 8, 16)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def base(spark):
    return lambda *ids, price=10: spark.createDataFrame([(i, f"row {i}", float(price * i)) for i in ids], "id long, name string, price double")


def target_of(df):
    return st.full(df, None, LoadSettings(), "old").target


def test_full_keeps_order_and_adopts_new_columns(spark, base):
    old = target_of(base(1, 2).select("price", "id"))
    out = st.full(base(1, 2, 3), old, LoadSettings(), NOW).target
    assert out.columns == ["price", "id", "row_hash", "_timestamp", "_deleted_in_source", "name"]
    assert out.count() == 3


def test_full_leaves_target_when_source_is_empty(base):
    old = target_of(base(1, 2))
    assert st.full(base(1).limit(0), old, LoadSettings(), NOW).target.count() == 2
    assert st.full(base(1).limit(0), old, LoadSettings(empty_rows_ok=True), NOW).target.count() == 0


def test_hash_is_taken_before_empty_text_becomes_null(spark):
    df = spark.createDataFrame([(1, "")], "id long, name string")
    r = st.prepare(df, LoadSettings(), NOW).first()
    assert r["name"] is None and r["row_hash"] == df.select(row_hash(df, df.columns)).first()[0]


def test_hash_known_answers(spark):
    import hashlib

    df = spark.createDataFrame([(1, 1.5)], "id long, cena double")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert df.select(row_hash(df, df.columns, promote=True)).first()[0] == sha("1.0||1.5")
    assert df.select(row_hash(df, df.columns)).first()[0] == sha("1||1.5")
    assert df.select(row_hash(df, [])).first()[0] == sha("")
    gone = spark.createDataFrame([(float("nan"), None), (None, "")], "x double, s string")
    assert {r[0] for r in gone.select(row_hash(gone, gone.columns)).collect()} == {sha("||")}


def test_hash_diff_flags_revives_and_ends(base):
    s = LoadSettings(method="hash", key="id")
    first = target_of(base(1, 2, 3))
    second = st.hash_diff(base(1, 3, 4), first, s, NOW).target
    assert rows(second, "id", "_deleted_in_source") == [(1, False), (2, True), (3, False), (4, False)]
    third = st.hash_diff(base(1, 2, 3, 4), second, s, NOW)
    assert rows(third.target, "id", "_deleted_in_source") == [(1, False), (2, False), (3, False), (4, False)]
    assert third.staged.count() == 0
    again = st.hash_diff(base(1, 2, 3, 4), third.target, s, NOW)
    assert again.staged.count() == 0 and rows(again.target, "id", "_timestamp") == rows(third.target, "id", "_timestamp")


def test_hash_diff_falls_back(spark, base):
    s = LoadSettings(method="hash", key="id")
    assert st.hash_diff(base(1), None, s, NOW).fallback_reason == "target_missing"
    assert st.hash_diff(base(1), target_of(base(1)).limit(0), s, NOW).fallback_reason == "target_empty"
    assert st.hash_diff(base(1), target_of(base(1)).drop("row_hash"), s, NOW).fallback_reason == "hash_column_missing"
    assert st.hash_diff(base(1), target_of(base(1)).selectExpr("id", "name", "price", "cast(null as string) row_hash", "_timestamp", "_deleted_in_source"), s, NOW).fallback_reason == "hash_all_null"
    assert st.hash_diff(base(*range(1, 30), price=7), target_of(base(*range(1, 30))), s, NOW).fallback_reason == "reseed"
    assert st.hash_diff(base(1), target_of(base(1)), LoadSettings(method="hash", key="id", ignore_hash=True), NOW).fallback_reason == "ignore_hash"


def test_null_flag_is_left_alone(spark):
    t = spark.createDataFrame([(1, None, "old"), (2, None, "old")], "id long, _deleted_in_source boolean, _timestamp string")
    out = m.mark_deleted(t, spark.createDataFrame([("1",)], "k string"), "id", NOW)
    assert rows(out, "id", "_deleted_in_source", "_timestamp") == [(1, None, "old"), (2, None, "old")]


def test_incremental_example(spark):
    cols = "id long, name string, date_modified string"
    old = target_of(spark.createDataFrame([(i, f"row {i}", "2026-01-01 00:00:00") for i in (1, 2, 3)], cols))
    src = spark.createDataFrame([(1, "row 1", "2026-01-01 00:00:00"), (2, "changed 2", "2026-08-15 00:00:00"), (4, "new 4", "2026-08-15 00:00:00")], cols)
    s = LoadSettings(method="incremental", key="id", updated_column="date_modified", days_back=14)
    out = st.incremental(src, old, s, NOW, AT).target
    assert [r[1] for r in rows(out, "id", "name")] == ["row 1", "changed 2", "row 3", "new 4"]


def test_incremental_takes_created_for_zero_dates(spark):
    src = spark.createDataFrame([(1, "0000-00-00", "2026-08-15"), (2, None, "2026-08-15"), (3, "0000-00-00", "2026-01-01"), (4, None, None)], "id long, u string, c string")
    old = target_of(src.where("id = 3"))
    s = LoadSettings(method="incremental", key="id", updated_column="u", created_column="c", zero_date="0000-00-00")
    assert rows(st.incremental(src, old, s, NOW, AT).staged, "id") == [(1,), (2,)]


def test_watermark_sees_only_higher_keys(base):
    out = st.id_watermark(base(1, 2, 5, price=3), target_of(base(2, 3)), LoadSettings(method="id_watermark", key="id"), NOW)
    assert rows(out.target, "id", "price") == [(2, 20.0), (3, 30.0), (5, 15.0)]


def test_parent_window(spark):
    kids = spark.createDataFrame([(1, 10, "a2"), (2, 10, "b2"), (3, 20, "c2")], "id long, parent_id long, descr string")
    old = target_of(spark.createDataFrame([(1, 10, "a"), (9, 10, "gone"), (3, 20, "c")], "id long, parent_id long, descr string"))
    parents = spark.createDataFrame([(10, "2026-08-14 00:00:00"), (20, "2026-06-17 00:00:00")], "id long, changed_at string")
    s = LoadSettings(method="parent_incremental", key="id", lookback_hours=168, parent_key="id", foreign_key="parent_id", parent_dates=("changed_at",))
    out = st.parent_incremental(kids, old, parents, None, s, NOW, AT).target
    assert rows(out, "id", "descr") == [(1, "a2"), (2, "b2"), (3, "c")]
    empty = st.parent_incremental(kids, old.limit(0), parents, None, s, NOW, AT).target
    assert rows(empty, "id") == [(1,), (2,)]


def test_slices_are_independent_and_skipped(spark, base):
    s = LoadSettings(method="full_by_source", key="id", fingerprint_mode="aggregate", fingerprint_columns=("price",))
    first = st.full_by_source({"a": base(1, 2), "b": base(1, 2)}, None, s, NOW)
    assert first.target.count() == 4
    second = st.full_by_source({"a": base(1, 2), "b": base(7, 8)}, first.target, s, NOW, first.fingerprints)
    assert second.skipped == ("a",)
    assert rows(second.target, "_source", "id") == [("a", 1), ("a", 2), ("b", 7), ("b", 8)]
    third = st.full_by_source({"a": base(1, 2)}, second.target.where("_source = 'b'"), s, NOW, first.fingerprints)
    assert third.skipped == ()


def test_batches_keep_repeats_within_but_not_across(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (1, 1, "z"), (2, 1, "w"), (None, 0, "n"), (None, 1, "m")], "id long, batch int, v string")
    assert sorted(r["v"] for r in m.dedup_batches(df, ["id"], "batch").collect()) == ["n", "w", "x", "y"]


def test_store_publishes_whole_versions(spark, base, tmp_path):
    store = TargetStore(spark, f"file://{tmp_path}/t")
    assert store.read() is None
    store.write(base(1))
    version = store.stage(base(1, 2))
    assert store.read().count() == 1 and store.stale() == [f"v-{version}"]
    store.publish(version)
    assert store.read().count() == 2
    with pytest.raises(ValueError):
        store.drop(store.current().rsplit("/", 1)[-1])
    store.drop(store.stale()[0])
    assert store.stale() == []


def test_run_end_to_end(spark, base, tmp_path):
    store = TargetStore(spark, f"file://{tmp_path}/t")
    raw = {"table": "t", "settings": {"method": "hash", "key": "id"}}
    r = run(spark, raw, {"main": base(1, 2)}, store, AT).first()
    assert (r["load_method"], r["fallback_reason"], r["rows_written"]) == ("full", "target_missing", 2)
    r = run(spark, raw, {"main": base(1, 2)}, store, AT).first()
    assert (r["load_method"], r["rows_written"], r["is_incremental"]) == ("hash", 0, True)
    r = run(spark, raw, {"main": base(2, 3)}, store, AT).first()
    assert r["rows_written"] == 1 and rows(store.read(), "id", "_deleted_in_source") == [(1, True), (2, False), (3, False)]
    assert run(spark, raw | {"sources": []}, {"main": base(1)}, store, AT).first()["load_method"] == "nothing_selected"


def test_run_leaves_target_on_failure(spark, base, tmp_path):
    store = TargetStore(spark, f"file://{tmp_path}/t")
    raw = {"table": "t", "settings": {"method": "full", "key": "id"}}
    run(spark, raw, {"main": base(1)}, store, AT)
    with pytest.raises(SourceError) as e:
        run(spark, raw, {"main": base(1, 1)}, store, AT)
    r = e.value.status.first()
    assert r["status"] == "error" and "DuplicateKeys" in r["error"] and store.read().count() == 1


def test_run_isolates_sources(spark, base, tmp_path):
    store, prints = (TargetStore(spark, f"file://{tmp_path}/{n}") for n in "tf")
    raw = {"table": "t", "dialect": "mssql", "settings": {"method": "full_by_source", "key": "id", "fingerprint_mode": "aggregate", "fingerprint_columns": ["price"]}}
    run(spark, raw, {"a": base(1, 2), "b": base(1)}, store, AT, fingerprints=prints)
    again = run(spark, raw, {"a": base(1, 2), "b": base(3)}, store, AT, fingerprints=prints)
    assert {r["source"]: r["load_method"] for r in again.collect()} == {"a": "unchanged", "b": "full_by_source"}
    assert rows(store.read(), "_source", "id") == [("a", 1), ("a", 2), ("b", 3)]
    with pytest.raises(SourceError):
        run(spark, raw, {"a": base(5, 5), "b": base(6)}, store, AT, fingerprints=prints)
    assert rows(store.read(), "_source", "id") == [("a", 1), ("a", 2), ("b", 6)]


def test_partitioned_target_moves_rows(spark, tmp_path):
    store = TargetStore(spark, f"file://{tmp_path}/t")
    df = lambda *r: spark.createDataFrame(list(r), "id long, doc_date string, m string")
    raw = {"table": "t", "settings": {"method": "incremental", "key": "id", "updated_column": "m", "partition_by": {"column": "doc_date", "mode": "range_month"}}}
    run(spark, raw, {"x": df((1, "2026-08-14", "2026-08-15 00:00:00"), (2, None, "2026-08-15 00:00:00"))}, store, AT)
    run(spark, raw, {"x": df((1, "2026-09-14", "2026-08-15 01:00:00"))}, store, AT)
    assert rows(store.read(), "id", "_partition") == [(1, "2026_09"), (2, "default")]


def test_stream_of_changes(spark, tmp_path):
    from pyspark.sql import functions as F

    from tideline.streaming.upsert import stream_into, upsert_batches

    store = TargetStore(spark, f"file://{tmp_path}/t")
    schema = "id long, v string, at long"
    for i, part in enumerate([[(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 3), (3, "e", 1)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_into(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, ["id"], [F.desc("at")], f"{tmp_path}/ck").awaitTermination()
    assert rows(store.read(), "id", "v") == [(1, "b"), (2, "d"), (3, "e")]
    before = store.current()
    upsert_batches(store, ["id"], [F.desc("at")])(spark.createDataFrame([(1, "old", 9)], schema), 1)
    assert store.current() == before


def test_diff_of_empty_tables(spark, base):
    empty = d.snapshot(base(1).limit(0), "id")
    assert d.counts(d.diff(empty, empty)).first().asDict() == {"added": 0, "changed": 0, "matched": 0, "deleted": 0, "source_rows": 0}


def test_run_cleans_names_promotes_and_drops_later_batches(spark, tmp_path):
    """The whole load path: names, text types, dates, integers near their limit, flags, decoded bytes, repeats across batches."""
    given = [(1, "2026-08-14", 5, "1", bytearray("příliš".encode("cp1250")), "007", 0, "a\r\nb"), (2, "0000-00-00", 2_100_000_000, "0", None, "", 0, "c\rd"), (2, "2026-01-01", 1, "0", None, "x", 1, None)]
    df = spark.createDataFrame(given, "id int, `Doc Date` string, big int, flag string, note binary, ean string, part int, `select` string")
    raw = {"table": "t", "dialect": "mssql", "types": {"id": "int", "doc date": "datetime", "big": "int", "note": "image", "ean": "varchar", "select": "nvarchar"}, "settings": {"method": "full", "key": "ID", "batch_column": "part", "reserved_words": ["SELECT"]}}
    store = TargetStore(spark, f"file://{tmp_path}/t")
    r = run(spark, raw, {"main": df}, store, AT).first()
    assert (r["status"], r["rows_written"]) == ("ok", 2)
    out = store.read()
    assert dict(out.dtypes) | {} == {"id": "int", "doc_date": "timestamp_ntz", "big": "bigint", "flag": "string", "note": "string", "ean": "string", "_select": "string", "row_hash": "string", "_timestamp": "string", "_deleted_in_source": "boolean"}
    assert rows_of(out) == [(1, datetime(2026, 8, 14), 5, "příliš", "007", "a\nb"), (2, None, 2_100_000_000, None, None, "c d")]
    enum = spark.createDataFrame([(1, "1"), (2, "0")], "id int, flag string")
    both = TargetStore(spark, f"file://{tmp_path}/e")
    run(spark, {"table": "e", "dialect": "mysql", "types": {"id": "int", "flag": "enum"}, "settings": {"key": "id"}}, {"main": enum}, both, AT)
    assert rows(both.read(), "id", "flag") == [(1, True), (2, False)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "doc_date", "big", "note", "ean", "_select").collect())


def test_strict_precision_stops_the_load(spark, tmp_path):
    store = TargetStore(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1, 9007199254740994.0)], "id long, n double")
    raw = {"table": "t", "types": {"n": "bigint"}, "settings": {"key": "id"}}
    with pytest.raises(SourceError, match="failed"):
        run(spark, raw | {"settings": {"key": "id", "strict_integer_precision": True}}, {"main": df}, store, AT)
    assert store.read() is None
    run(spark, raw, {"main": df}, store, AT)
    assert rows(store.read(), "id", "n") == [(1, 9007199254740994)]


def test_target_without_managed_columns_gets_them(spark, base, tmp_path):
    store = TargetStore(spark, f"file://{tmp_path}/t")
    store.write(spark.createDataFrame([(1, "u")], "id long, u string"))
    src = spark.createDataFrame([(2, "2026-08-15 00:00:00")], "id long, u string")
    run(spark, {"table": "t", "settings": {"method": "incremental", "key": "id", "updated_column": "u"}}, {"m": src}, store, AT)
    assert store.read().columns == ["id", "u", "row_hash", "_timestamp", "_deleted_in_source"]
    assert rows(store.read(), "id", "_deleted_in_source") == [(1, False), (2, False)]


def test_partitions_of_an_existing_target_hold(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-08-14")], "id long, d string")
    store = TargetStore(spark, f"file://{tmp_path}/t")
    store.write(st.full(df, None, LoadSettings(), "old").target)
    raw = {"table": "t", "settings": {"key": "id", "partition_by": {"column": "d", "mode": "range_month"}}}
    with pytest.warns(UserWarning, match="without partitions"):
        run(spark, raw, {"m": df}, store, AT)
    assert "_partition" not in store.read().columns


def test_several_sources_need_slices(spark, base, tmp_path):
    from tideline.plans.config import ConfigError

    store = TargetStore(spark, f"file://{tmp_path}/t")
    for raw in ({"table": "t"}, {"table": "t", "sources": ["a", "b"]}):
        with pytest.raises(ConfigError, match="full_by_source"):
            run(spark, raw, {"a": base(1), "b": base(2)}, store, AT)


def test_slices_have_no_hash_unless_asked(spark, base):
    for given, null in ((None, True), (True, False)):
        s = LoadSettings(method="full_by_source", compute_row_hash=given)
        assert st.full_by_source({"a": base(1)}, None, s, NOW).target.first()["row_hash"] is None or not null
        assert (st.full_by_source({"a": base(1)}, None, s, NOW).target.where("row_hash IS NULL").count() == 1) == null


def test_windows(spark):
    src = spark.createDataFrame([(1, 46000, 46300), (2, 46000, 46000), (3, None, 46300), (4, 46300, None), (5, None, None)], "id long, a int, b int")
    s = LoadSettings(method="incremental", key="id", date_column="a", created_column="b", lookback_hours=24)
    cond, since = st.window(src, s, AT)
    assert since == "2026-08-15 00:00:00" and rows(src.where(cond), "id") == [(1,), (3,), (4,)]
    assert st.window(src, LoadSettings(date_column="a", days_back=3), AT)[1] == "2026-01-01 00:00:00"
    assert st.window(src, LoadSettings(updated_column="a", days_back=3), AT)[1] == "2026-08-13 00:00:00"


def test_filters_reach_the_scan(spark, sf, capsys):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    from tideline.operators import predicates as p

    p.above_watermark(o, o.where("o_orderkey < 100"), "o_orderkey").explain("formatted")
    assert "GreaterThan(o_orderkey" in capsys.readouterr().out
    o.where(p.coalesce_window(o["o_orderdate"], o["o_orderdate"], "1997-01-01")).explain("formatted")
    assert "GreaterThanOrEqual(o_orderdate" in capsys.readouterr().out


def test_csv_and_scratch(spark, tmp_path):
    from tideline.sources.store import drop_scratch, scratch_path, write_csv

    write_csv(spark.createDataFrame([(1, 'a "q"\nb'), (2, None)], "id long, s string").coalesce(1), f"{tmp_path}/c")
    text = next((tmp_path / "c").glob("part*.csv")).read_text()
    assert text == '"id","s"\n"1","a ""q""\nb"\n"2",""\n'
    at = scratch_path(f"file://{tmp_path}")
    spark.range(3).write.parquet(at)
    drop_scratch(spark, at)
    assert not list(tmp_path.glob("tideline_scratch_*"))
    for bad in (f"{tmp_path}/c", f"{at}/../c", ""):
        with pytest.raises(ValueError):
            drop_scratch(spark, bad)
    assert (tmp_path / "c").exists()
