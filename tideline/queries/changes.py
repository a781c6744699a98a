"""Hashing, snapshot diff, merges, load methods and fingerprints over the orders, lineitem and customer tables.

The old target is a fixed disturbance of orders: a tenth of the rows missing, a seventh with another
price, and some that the source no longer has.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as h
from ..functions.naming import target_column_names
from ..operators import diff as d
from ..operators import merge as m
from ..operators import predicates as p
from ..operators.fingerprint import fingerprint, unchanged_slices
from ..plans import strategies as st
from ..plans.config import LoadSettings
from ..sources.tables import fan_in, project, read_table, select_columns

COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
NOW, AT = "2001-08-02T00:00:00Z", datetime(2001, 8, 2)
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(*COLS)


def old_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = o.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", price)
    return kept.unionByName(o.where("o_orderkey % 50 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000))


def old_target(spark: SparkSession, sf: str) -> DataFrame:
    """The old target with its managed columns; every ninth row is flagged as deleted."""
    o = old_orders(spark, sf)
    return o.withColumns({"row_hash": h.row_hash(o, COLS), "_timestamp": F.lit("old"), "_deleted_in_source": F.col("o_orderkey") % 9 == 0})


def shown(df: DataFrame, *more: str) -> DataFrame:
    """Orders rows for comparison: dates as text."""
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), *more)


_HASH = "sha256(concat_ws('||', coalesce(cast(o_orderkey AS varchar), ''), coalesce(cast(o_custkey AS varchar), ''), coalesce(o_orderstatus, ''), coalesce(cast(o_totalprice AS varchar), ''), coalesce(cast(o_orderdate AS varchar), ''), coalesce(o_orderpriority, '')))"
_OLD = """old AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 50 = 1
)"""
_SNAP = f"s AS (SELECT cast(o_orderkey AS varchar) AS k, {_HASH} AS h FROM orders), {_OLD}, t AS (SELECT cast(o_orderkey AS varchar) AS k, {_HASH} AS h FROM old)"
_STATUS = f"{_SNAP}, j AS (SELECT coalesce(s.k, t.k) AS k, s.h AS source_hash, t.h AS target_hash, CASE WHEN t.k IS NULL THEN 'added' WHEN s.k IS NULL THEN 'deleted' WHEN s.h IS DISTINCT FROM t.h THEN 'changed' ELSE 'matched' END AS status FROM s FULL OUTER JOIN t ON s.k = t.k)"
_SHOW = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate"


def _status(spark, sf):
    return d.diff(d.snapshot(orders(spark, sf), "o_orderkey"), d.snapshot(old_orders(spark, sf), "o_orderkey"))


@query(f"WITH {_STATUS} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status <> 'deleted') AS source_rows FROM j")
def hash_diff_counts(spark, sf):
    return d.counts(_status(spark, sf))


@query(f"WITH {_STATUS} SELECT k, source_hash, target_hash, status FROM j")
def hash_diff_status_per_key(spark, sf):
    return _status(spark, sf)


@query(f"WITH {_STATUS} SELECT k, status FROM j WHERE status IN ('added', 'changed')")
def changed_keys(spark, sf):
    return d.changed_keys(_status(spark, sf))


@query(f"WITH {_STATUS}, c AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'matched') AS matched FROM j), n AS (SELECT count(*) AS target_rows, count(*) FILTER (o_orderkey % 4 = 0) AS null_hashes FROM old) SELECT c.*, n.*, (changed >= target_rows * 0.95 AND matched = 0 AND target_rows > 0) OR (added + changed >= target_rows AND null_hashes > 0) AS reseed FROM c, n")
def reseed_decision(spark, sf):
    target = old_target(spark, sf).withColumn("row_hash", F.when(F.col("o_orderkey") % 4 != 0, F.col("row_hash")))
    return d.reseed_decision(_status(spark, sf), target, "row_hash")


@query(f"WITH {_OLD}, a AS (SELECT count(*) AS target_rows, count(*) FILTER (o_orderkey % 4 = 0) AS null_hashes FROM old) SELECT target_rows, null_hashes, CASE WHEN target_rows = 0 THEN 'target_empty' WHEN target_rows = null_hashes THEN 'hash_all_null' ELSE 'none' END AS reason FROM a")
def hash_precheck(spark, sf):
    return d.precheck_frame(old_target(spark, sf).withColumn("row_hash", F.when(F.col("o_orderkey") % 4 != 0, F.col("row_hash"))), "row_hash")


@query(f"SELECT o_orderkey, {_HASH} AS row_hash FROM orders")
def row_hash_orders(spark, sf):
    o = orders(spark, sf)
    return o.select("o_orderkey", h.row_hash(o, COLS).alias("row_hash"))


@query("SELECT o_orderkey, sha256(concat_ws('||', coalesce(cast(o_custkey AS varchar), ''), CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderstatus END)) AS row_hash FROM orders")
def row_hash_include_exclude(spark, sf):
    o = orders(spark, sf).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")))
    cols = h.hash_columns(o.columns, ["o_orderstatus", "o_custkey", "o_orderkey"], ["o_orderkey"])
    return o.select("o_orderkey", h.row_hash(o, cols).alias("row_hash"))


@query("SELECT o_orderkey, sha256(concat_ws('||', " + ", ".join(f"coalesce(cast(o_custkey + {i} AS varchar), ''), coalesce(o_orderpriority || '{i}', '')" for i in range(24)) + ")) AS row_hash FROM orders")
def row_hash_of_a_wide_table(spark, sf):
    """48 columns, half of them text."""
    wide = [x for i in range(24) for x in ((F.col("o_custkey") + i).alias(f"n{i}"), F.concat(F.col("o_orderpriority"), F.lit(str(i))).alias(f"t{i}"))]
    o = orders(spark, sf).select("o_orderkey", *wide)
    return o.select("o_orderkey", h.row_hash(o, o.columns[1:]).alias("row_hash"))


@query("SELECT p_partkey, sha256(concat_ws('||', cast(cast(p_partkey AS double) AS varchar), cast(cast(p_size AS double) AS varchar), cast(p_retailprice AS varchar))) AS row_hash FROM part")
def row_hash_promoted(spark, sf):
    t = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return t.select("p_partkey", h.row_hash(t, t.columns, promote=True).alias("row_hash"))


@query()
def row_hash_utf16_upper(spark, sf):
    o = orders(spark, sf)
    return o.select("o_orderkey", h.row_hash_utf16(o, ["o_orderkey", "o_orderpriority"]).alias("row_hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE cast(o_custkey AS varchar) END AS k FROM orders")
def pk_to_str(spark, sf):
    return orders(spark, sf).select("o_orderkey", h.key_text(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey"))).alias("k"))


@query("SELECT o_orderkey, md5(concat_ws(chr(31), coalesce('''' || replace(cast(o_orderkey AS varchar), '''', '''''') || '''', 'NULL'), coalesce('''' || replace(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END, '''', '''''') || '''', 'NULL'))) AS content FROM orders")
def content_hash(spark, sf):
    o = orders(spark, sf).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", h.content_hash(o, ["o_orderkey", "o_orderpriority"]).alias("content"))


# --- merges ---------------------------------------------------------------------------------


@query(f"WITH {_OLD}, st AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0) SELECT {_SHOW} FROM st UNION ALL SELECT {_SHOW} FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM st)")
def upsert_orders(spark, sf):
    return shown(m.upsert(old_orders(spark, sf), orders(spark, sf).where("o_orderkey % 3 = 0"), ["o_orderkey"]))


@query(f"WITH {_OLD}, st AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate + INTERVAL 40 DAY AS o_orderdate FROM orders WHERE o_orderkey % 5 = 1), n AS (SELECT o_orderkey, o_orderdate FROM st UNION ALL SELECT o_orderkey, o_orderdate FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM st)) SELECT strftime(o_orderdate, '%Y_%m') AS part, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM n GROUP BY 1")
def replace_by_key(spark, sf):
    staged = orders(spark, sf).where("o_orderkey % 5 = 1").withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 40 DAY"))
    out = m.replace_by_key(old_orders(spark, sf), staged, ["o_orderkey"])
    return out.groupBy(F.date_format("o_orderdate", "yyyy_MM").alias("part")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


_SRC = "by_region AS (SELECT o.*, r_name AS _source FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def by_region(spark, sf):
    t = lambda n: read_table(spark, sf, n)
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    # nation and region are fixed tables of a few rows
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("_source"))
    return orders(spark, sf).join(c.join(F.broadcast(places), "n_nationkey").select("o_custkey", "_source"), "o_custkey").select(*COLS, "_source")


@query(f"WITH {_SRC} SELECT _source, count(*) AS n, sum(CASE WHEN o_orderkey < 0 THEN 1 ELSE 0 END)::BIGINT AS negative FROM (SELECT o_orderkey, _source FROM by_region WHERE _source <> 'ASIA' UNION ALL SELECT -1 - o_orderkey, 'ASIA' FROM by_region WHERE _source = 'ASIA' AND o_orderkey % 2 = 0) GROUP BY 1")
def replace_source_slice(spark, sf):
    target = by_region(spark, sf)
    staged = target.where("_source = 'ASIA' AND o_orderkey % 2 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")).drop("_source")
    out = m.replace_slice(target, staged, "ASIA")
    return out.groupBy("_source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderkey") < 0, 1).otherwise(0)).alias("negative"))


@query(f"WITH {_OLD}, f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 9 = 0 END AS flag FROM old), x AS (SELECT f.*, o.o_orderkey IS NOT NULL AS live FROM f LEFT JOIN orders o ON o.o_orderkey = f.o_orderkey) SELECT o_orderkey, CASE WHEN flag AND live THEN false WHEN NOT flag AND NOT live THEN true ELSE flag END AS _deleted_in_source, CASE WHEN (flag AND live) OR (NOT flag AND NOT live) THEN '{NOW}' ELSE 'old' END AS _timestamp FROM x")
def mark_deleted_in_source(spark, sf):
    t = old_target(spark, sf).withColumn("_deleted_in_source", F.when(F.col("o_orderkey") % 11 != 0, F.col("_deleted_in_source")))
    live = orders(spark, sf).select(h.key_text(F.col("o_orderkey")).alias("k"))
    return m.mark_deleted(t, live, "o_orderkey", NOW).select("o_orderkey", "_deleted_in_source", "_timestamp")


_LINES = "l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_suppkey % 4 AS batch FROM lineitem)"


@query(f"WITH {_LINES}, f AS (SELECT l_orderkey, l_linenumber, min(batch) AS first FROM l GROUP BY 1, 2) SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, l.batch FROM l JOIN f ON f.l_orderkey = l.l_orderkey AND f.l_linenumber = l.l_linenumber AND f.first = l.batch")
def dedup_seen_keys(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_suppkey") % 4).alias("batch"))
    return m.dedup_batches(lines, ["l_orderkey", "l_linenumber"], "batch")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_violations(spark, sf):
    return m.key_violations(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS id, o_orderstatus AS _type, NULL::VARCHAR AS absent FROM orders")
def align_to_target(spark, sf):
    staged = orders(spark, sf).select(F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("type"), F.col("o_custkey").alias("extra"))
    return m.align(staged, ["id", "_type", "absent"], {"absent": "string"})


# --- predicates and reads ----------------------------------------------------------------------

_DIRTY = "v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '0000-00-00 00:00:00' WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS updated, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') END AS created FROM orders)"


def _stamped(spark, sf):
    key, text = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return orders(spark, sf).select("o_orderkey", F.when(key % 11 == 0, "0000-00-00 00:00:00").when(key % 13 == 0, None).otherwise(text(F.col("o_orderdate"))).alias("updated"), F.when(key % 17 != 0, text(F.expr("o_orderdate - INTERVAL 3 DAY"))).alias("created"))


@query(f"WITH {_DIRTY} SELECT o_orderkey, updated, created FROM v WHERE coalesce(nullif(updated, '0000-00-00 00:00:00'), created) >= '2001-01-01 00:00:00'")
def incremental_coalesce_window(spark, sf):
    return _stamped(spark, sf).where(p.coalesce_window(F.col("updated"), F.col("created"), "2001-01-01 00:00:00", "0000-00-00 00:00:00"))


@query("WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS b FROM orders) SELECT o_orderkey, cast(a AS varchar) AS a, cast(b AS varchar) AS b FROM v WHERE coalesce(a, 0) >= 900 OR coalesce(b, 0) >= 900")
def incremental_or_window(spark, sf):
    o = orders(spark, sf).select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("b"))
    return o.where(p.either_window(F.col("a"), F.col("b"), 900)).select("o_orderkey", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


@query("SELECT o_orderkey, date_diff('day', DATE '1899-12-30', cast(o_orderdate AS date)) AS day_number FROM orders")
def day_number_cutoff(spark, sf):
    return orders(spark, sf).select("o_orderkey", p.day_number(F.col("o_orderdate")).cast("bigint").alias("day_number"))


@query(f"WITH {_STATUS} SELECT {_SHOW} FROM orders JOIN j ON j.k = cast(o_orderkey AS varchar) AND j.status IN ('added', 'changed')")
def fetch_changed_rows(spark, sf):
    return shown(p.with_keys(orders(spark, sf), d.changed_keys(_status(spark, sf)), "o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def children_of_parents(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return p.children_of(lines, orders(spark, sf), "l_orderkey", "o_orderkey", F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 700 AND o_orderstatus = 'F'")
def keyset_resume(spark, sf):
    return orders(spark, sf).where(p.after_key(F.col("o_orderkey"), 700, F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("SELECT cast(o_orderkey AS varchar) || '-' || o_orderstatus AS sk, o_orderkey AS key, o_totalprice FROM orders WHERE (o_totalprice > 1000)")
def projection_surrogate_rename(spark, sf):
    o = orders(spark, sf)
    cols = select_columns(o.columns, ["O_ORDERKEY", "o_totalprice", "o_custkey"], ["o_custkey"], ["o_orderkey"])
    return project(o, cols, "(o_totalprice > 1000)", ("sk", "concat(cast(o_orderkey AS string), '-', o_orderstatus)"), {"o_orderkey": "key"})


@query("SELECT s._source, s.id, s.name, s.extra FROM (SELECT 'customers' AS _source, c_custkey AS id, c_name AS name, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_name, cast(s_suppkey % 3 AS varchar) FROM supplier) s")
def multi_source_fan_in(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 3).cast("string").alias("extra"))
    return fan_in({"customers": c, "suppliers": s})


# --- load methods -----------------------------------------------------------------------------------

_MANAGED = "row_hash, _timestamp, _deleted_in_source"


def managed(df):
    return shown(df, "row_hash", "_timestamp", "_deleted_in_source")


@query(f"SELECT {_SHOW}, {_HASH} AS row_hash, '{NOW}' AS _timestamp, false AS _deleted_in_source FROM orders")
def full_load(spark, sf):
    return managed(st.full(orders(spark, sf), old_target(spark, sf), LoadSettings(), NOW).target)


@query(f"WITH {_OLD}, st AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-19') SELECT {_SHOW}, {_HASH} AS row_hash, '{NOW}' AS _timestamp, false AS _deleted_in_source FROM st UNION ALL SELECT {_SHOW}, {_HASH}, 'old', o_orderkey % 9 = 0 FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM st)")
def incremental_load(spark, sf):
    s = LoadSettings(method="incremental", key="o_orderkey", updated_column="o_orderdate")
    return managed(st.incremental(orders(spark, sf), old_target(spark, sf), s, NOW, AT).target)


_APPLIED = f"{_STATUS}, moved AS (SELECT k FROM j WHERE status IN ('added', 'changed')), live AS (SELECT o.*, {_HASH} AS row_hash FROM orders o), rest AS (SELECT o.*, {_HASH} AS row_hash, o_orderkey % 9 = 0 AS flag, cast(o_orderkey AS varchar) IN (SELECT k FROM s) AS alive FROM old o WHERE cast(o_orderkey AS varchar) NOT IN (SELECT k FROM moved))"
_APPLIED_ROWS = f"SELECT {_SHOW}, row_hash, '{NOW}' AS _timestamp, false AS _deleted_in_source FROM live WHERE cast(o_orderkey AS varchar) IN (SELECT k FROM moved) UNION ALL SELECT {_SHOW}, row_hash, CASE WHEN flag = alive THEN '{NOW}' ELSE 'old' END, NOT alive FROM rest"


@query(f"WITH {_APPLIED} {_APPLIED_ROWS}")
def hash_diff_apply(spark, sf):
    return managed(st.hash_diff(orders(spark, sf), old_target(spark, sf), LoadSettings(method="hash", key="o_orderkey"), NOW).target)


@query("SELECT 0::BIGINT AS added, 0::BIGINT AS changed, (SELECT count(*) FROM orders) AS matched, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 1) AS deleted, (SELECT count(*) FROM orders) AS source_rows")
def second_run_is_empty(spark, sf):
    s = LoadSettings(method="hash", key="o_orderkey")
    once = st.hash_diff(orders(spark, sf), old_target(spark, sf), s, NOW).target
    return d.counts(st.hash_diff(orders(spark, sf), once, s, NOW).status)


@query(f"WITH old AS (SELECT * FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) / 2 FROM orders)) SELECT {_SHOW}, {_HASH} AS row_hash, '{NOW}' AS _timestamp, false AS _deleted_in_source FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM old) UNION ALL SELECT {_SHOW}, {_HASH}, 'old', o_orderkey % 9 = 0 FROM old")
def id_watermark(spark, sf):
    o = orders(spark, sf)
    half = o.agg((F.max("o_orderkey") / 2).alias("half"))
    old = o.join(F.broadcast(half), F.col("o_orderkey") <= F.col("half")).select(*COLS)
    old = old.withColumns({"row_hash": h.row_hash(old, COLS), "_timestamp": F.lit("old"), "_deleted_in_source": F.col("o_orderkey") % 9 == 0})
    return managed(st.id_watermark(o, old, LoadSettings(method="id_watermark", key="o_orderkey"), NOW).target)


_CHILD = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"WITH win AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-04'), old AS ({_CHILD} FROM lineitem WHERE l_partkey % 5 <> 0 UNION ALL SELECT l_orderkey, l_partkey + 1000000, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey % 20 = 1) {_CHILD}, '{NOW}' AS _timestamp FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM win) UNION ALL {_CHILD}, 'old' FROM old WHERE l_orderkey NOT IN (SELECT o_orderkey FROM win)")
def parent_incremental(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    old = lines.where("l_partkey % 5 <> 0").unionByName(lines.where("l_partkey % 20 = 1").withColumn("l_partkey", F.col("l_partkey") + 1000000))
    old = old.withColumns({"row_hash": F.lit("x"), "_timestamp": F.lit("old"), "_deleted_in_source": F.lit(False)})
    s = LoadSettings(method="parent_incremental", key="l_partkey", lookback_hours=24 * 90, parent_key="o_orderkey", foreign_key="l_orderkey", parent_dates=("o_orderdate",))
    out = st.parent_incremental(lines, old, orders(spark, sf), None, s, NOW, AT).target
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "_timestamp")


@query(f"WITH {_SRC} SELECT _source, count(*) AS n, count(*) FILTER (o_orderkey % 10 <> 0) AS old_rows, CASE WHEN _source = 'EUROPE' THEN 'old' ELSE '{NOW}' END AS _timestamp FROM by_region WHERE _source <> 'EUROPE' OR o_orderkey % 10 <> 0 GROUP BY 1")
def full_by_source(spark, sf):
    """All regions but one are replaced; that one is not among the sources."""
    rows = by_region(spark, sf)
    base = rows.where("o_orderkey % 10 <> 0")
    target = base.select(*COLS, h.row_hash(base, COLS).alias("row_hash"), F.lit("old").alias("_timestamp"), F.lit(False).alias("_deleted_in_source"), "_source")
    names = ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"]
    sources = {n: rows.where(F.col("_source") == n).select(*COLS) for n in names}
    out = st.full_by_source(sources, target, LoadSettings(method="full_by_source", key="o_orderkey"), NOW).target
    return out.groupBy("_source", "_timestamp").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 10 != 0).alias("old_rows"))


# --- fingerprints ---------------------------------------------------------------------------------------

_PRINT = "count(*) AS row_count, cast(max(o_orderkey) AS varchar) AS max_id, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS max_ts"


@query("SELECT count(*) AS row_count, cast(max(event_id) AS varchar) AS max_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS max_ts, NULL::VARCHAR AS agg, cast(count(*) AS varchar) || '|' || cast(max(event_id) AS varchar) || '|' || strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '|' AS fingerprint FROM events")
def fingerprint_stamp(spark, sf):
    return fingerprint(read_table(spark, sf, "events"), "event_id", "ts").withColumn("agg", F.col("agg").cast("string"))


_SUM = "cast(cast(sum(cast(o_totalprice AS decimal(28,6))) AS decimal(38,6)) + cast(sum(cast(o_custkey AS decimal(28,6))) AS decimal(38,6)) AS varchar)"


@query(f"WITH {_SRC} SELECT _source, {_PRINT}, {_SUM} AS agg, concat_ws('|', cast(count(*) AS varchar), cast(max(o_orderkey) AS varchar), strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S'), {_SUM}) AS fingerprint FROM by_region GROUP BY _source")
def fingerprint_aggregate(spark, sf):
    return fingerprint(by_region(spark, sf), "o_orderkey", "o_orderdate", ["o_totalprice", "o_custkey"], ["_source"]).withColumn("agg", F.col("agg").cast("string"))


@query(f"WITH {_SRC} SELECT _source FROM by_region WHERE _source IN ('AFRICA', 'AMERICA', 'ASIA') GROUP BY 1")
def fingerprint_skip(spark, sf):
    """EUROPE has one order less than before, MIDDLE EAST is no longer in the target."""
    rows = by_region(spark, sf)
    before = fingerprint(rows, "o_orderkey", None, ["o_totalprice"], ["_source"])
    last = rows.where("_source = 'EUROPE'").agg(F.max("o_orderkey").alias("_last"))
    now = rows.join(F.broadcast(last), (F.col("_source") == "EUROPE") & (F.col("o_orderkey") == F.col("_last")), "left_anti")
    now = fingerprint(now, "o_orderkey", None, ["o_totalprice"], ["_source"])
    return unchanged_slices(now, before, rows.where("_source <> 'MIDDLE EAST'")).select("_source")


_DIRTY = "WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN NULL ELSE o_orderdate END AS d, o_custkey, o_orderpriority, o_orderkey % 2 = 0 AS even, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || chr(10) || 'b' WHEN o_orderkey % 3 = 1 THEN 'c d' END AS note FROM orders) "


@query(_DIRTY + "SELECT k AS order_no, CASE WHEN k % 11 < 2 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS doc_date, cast(o_custkey + 2100000000 AS BIGINT) AS big, even AS flag, note, cast(o_custkey AS varchar) AS _select, 64::BIGINT AS hash_length, false AS _deleted_in_source FROM x")
def load_of_a_dirty_table(spark, sf):
    """The whole load path of method full over a table with names to clean, sentinel dates, an enumeration of 0 and 1, integers near
    their limit, carriage returns, numbers declared as text, and rows that come again in a later batch."""
    k = F.col("o_orderkey")
    day = F.when(k % 11 == 0, "0000-00-00").when(k % 11 == 1, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    note = F.when(k % 3 == 0, "a\r\nb").when(k % 3 == 1, "c\rd").otherwise("")
    o = orders(spark, sf).select(k.alias("Order No"), day.alias("Doc Date "), (F.col("o_custkey") + 2100000000).cast("long").alias("big"), (1 - k % 2).cast("string").alias("flag"), note.alias("note"), F.col("o_custkey").alias("select"), F.lit(0).alias("part"))
    again = o.where("`Order No` % 5 = 0").withColumn("part", F.lit(1)).withColumn("note", F.lit("later"))
    settings = LoadSettings(key="order_no", batch_column="part")
    names = {"Order No": "order_no", "Doc Date ": "doc_date", "select": "_select"}
    found = target_column_names(o.columns, ["SELECT"])[0]
    assert {a: found[a] for a in names} == names
    source = o.unionByName(again).toDF(*found.values())
    declared = st.Declared("mysql", {"order_no": "bigint", "doc_date": "date", "big": "int", "flag": "enum", "note": "text", "_select": "varchar"})
    out = st.full(source, None, settings, NOW, d=declared).target
    return out.select("order_no", F.date_format("doc_date", "yyyy-MM-dd").alias("doc_date"), "big", "flag", "note", "_select", F.length("row_hash").cast("long").alias("hash_length"), "_deleted_in_source")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN date_diff('day', DATE '1899-12-30', cast(o_orderdate AS date)) END, 0) >= 35795 OR coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 35800 END, 0) >= 35795")
def older_window(spark, sf):
    """The older shape of a window, over day numbers: either column on or after 1 January 1998."""
    k = F.col("o_orderkey")
    o = orders(spark, sf).select(k, F.when(k % 3 != 0, F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))).alias("a"), F.when(k % 2 == 0, 35800).alias("b"))
    cond, _ = st.window(o, LoadSettings(date_column="a", created_column="b"), datetime(1998, 8, 1))
    return o.where(cond).select("o_orderkey")
