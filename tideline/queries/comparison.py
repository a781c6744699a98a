"""The comparator's levels over orders and the disturbed copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_hash
from ..operators import compare as cmp
from ..operators.checksum import checksums
from ..operators.merge import align
from ..plans import strategies as st
from ..plans.config import LoadSettings
from ..sources.tables import read_table
from .changes import _HASH, _OLD, COLS, NOW, old_orders, old_target, orders

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _h(at: int, text: str) -> str:
    return f"cast(cast(sum(('0x' || substr(md5({text}), {at}, 8))::BIGINT) AS decimal(38,0)) AS varchar)"


def _measures(col: str, parts: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{col}' AS \"column\", '{m}' AS measure, {x} AS value FROM {source}" for m, x in parts.items())


def _numeric(c: str) -> dict[str, str]:
    return {"nulls": f"cast(count(*) FILTER ({c} IS NULL) AS varchar)", **{m: f"cast({m}({c}) AS varchar)" for m in ("sum", "min", "max")}}


def _float(c: str) -> dict[str, str]:
    """Doubles whose shortest text is without an exponent."""
    x = f"(CASE WHEN isfinite({c}) THEN {c} END)"
    t = f"cast({x} AS varchar)"
    return {"nulls": f"cast(count(*) FILTER ({c} IS NULL) AS varchar)", "min": f"cast(min({x}) AS varchar)", "max": f"cast(max({x}) AS varchar)", "h1": _h(1, t), "h2": _h(9, t), "nonfinite": f"cast(count(*) FILTER ({c} IS NOT NULL AND NOT isfinite({c})) AS varchar)"}


def _text(c: str) -> dict[str, str]:
    return {"nulls": f"cast(count(*) FILTER ({c} IS NULL) AS varchar)", "min": f"min({c})", "max": f"max({c})", "h1": _h(1, c), "h2": _h(9, c), "chars": f"cast(sum(length({c})) AS varchar)"}


def _temporal(c: str, fmt: str = "%Y-%m-%d %H:%M:%S.%f") -> dict[str, str]:
    t = f"strftime({c}, '{fmt}')"
    return {"nulls": f"cast(count(*) FILTER ({c} IS NULL) AS varchar)", "min": f"min({t})", "max": f"max({t})", "h1": _h(1, t), "h2": _h(9, t)}


def _sql(source: str, **columns: dict[str, str]) -> str:
    rows = f"SELECT '' AS \"column\", 'row_count' AS measure, cast(count(*) AS varchar) AS value FROM {source}"
    return " UNION ALL ".join([rows, *(_measures(c, p, source) for c, p in columns.items())])


@query(_sql("orders", o_orderkey=_numeric("o_orderkey"), o_custkey=_numeric("o_custkey")))
def checksum_numeric(spark, sf):
    return checksums(orders(spark, sf), ["o_orderkey", "o_custkey"])


@query("WITH e AS (SELECT CASE WHEN event_id % 100 = 1 THEN 'nan'::DOUBLE WHEN event_id % 100 = 2 THEN 'inf'::DOUBLE WHEN event_id % 100 = 3 THEN NULL ELSE value END AS v FROM events) " + _sql("e", v=_float("v")))
def checksum_float(spark, sf):
    k = F.col("event_id") % 100
    v = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, None).otherwise(F.col("value"))
    return checksums(read_table(spark, sf, "events").select(v.alias("v")), ["v"])


_SMALL = "WITH o AS (SELECT cast(o_orderkey AS decimal(20,0)) AS k FROM orders), e AS (SELECT k * 100000 + 7 AS wide, cast(cast(k AS varchar) || '.000000000000000001' AS decimal(38,18)) AS fine, cast(k AS decimal(18,4)) AS price FROM o) "


@query(_SMALL + "SELECT 'fine' AS \"column\", cast(sum(cast(trunc(fine) AS decimal(38,0))) AS varchar) || '+' || cast(cast(count(*) AS decimal(20,0)) * cast('0.000000000000000001' AS decimal(18,18)) AS varchar) AS total FROM e UNION ALL SELECT 'price', cast(sum(price) AS varchar) FROM e UNION ALL SELECT 'wide', cast(sum(wide) AS varchar) FROM e")
def checksum_exact_decimals(spark, sf):
    """Sums at the column's own scale; parts of wide ones are shown without the part of 10**19, which is 0 here."""
    k = F.col("o_orderkey")
    e = orders(spark, sf).select((k.cast("decimal(27,0)") * 100000 + 7).cast("decimal(38,0)").alias("wide"), F.concat(k.cast("string"), F.lit(".000000000000000001")).cast("decimal(38,18)").alias("fine"), k.cast("decimal(18,4)").alias("price"))
    return checksums(e).where("measure = 'sum'").select("column", F.regexp_replace("value", r"^0[+]", "").alias("total"))


@query("SELECT 'DIFF' AS tiny, 'DIFF' AS huge, 'MATCH' AS same")
def checksum_sees_small_and_large_doubles(spark, sf):
    """1e-9 against 2e-9 and 1e25 against 2e25 in one row of a whole table."""
    o = orders(spark, sf)
    least = o.agg(F.min("o_orderkey")).first()[0]
    table = lambda v: o.select(F.when(F.col("o_orderkey") == least, v).otherwise(F.col("o_totalprice")).alias("v"))
    verdicts = [cmp.compare("t", table(a), table(b)).verdict for a, b in ((1e-9, 2e-9), (1e25, 2e25), (1e25, 1e25))]
    return spark.createDataFrame([tuple(verdicts)], "tiny string, huge string, same string")


@query("WITH e AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS b FROM orders) " + _sql("e", b={"nulls": "cast(count(*) FILTER (b IS NULL) AS varchar)", "true": "cast(count(*) FILTER (b) AS varchar)", "false": "cast(count(*) FILTER (NOT b) AS varchar)"}))
def checksum_boolean(spark, sf):
    return checksums(orders(spark, sf).select(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 2 == 0).alias("b")), ["b"])


@query("WITH e AS (SELECT ts, cast(ts AS date) AS d FROM events) " + _sql("e", ts=_temporal("ts"), d=_temporal("d", "%Y-%m-%d")))
def checksum_temporal(spark, sf):
    return checksums(read_table(spark, sf, "events").select("ts", F.col("ts").cast("date").alias("d")), ["ts", "d"])


@query(_sql("documents", text=_text("text"), lang=_text("lang")))
def checksum_text(spark, sf):
    return checksums(read_table(spark, sf, "documents"), ["text", "lang"])


@query("WITH e AS (SELECT encode(c_name) AS b FROM customer) " + _sql("e", b={"nulls": "cast(count(*) FILTER (b IS NULL) AS varchar)", "bytes": "cast(sum(octet_length(b)) AS varchar)", "h1": _h(1, "lower(hex(b))"), "h2": _h(9, "lower(hex(b))")}))
def checksum_binary(spark, sf):
    return checksums(read_table(spark, sf, "customer").select(F.encode("c_name", "utf-8").alias("b")), ["b"])


_ALL = {"o_orderkey": _numeric("o_orderkey"), "o_custkey": _numeric("o_custkey"), "o_orderstatus": _text("o_orderstatus"), "o_totalprice": _float("o_totalprice"), "o_orderdate": _temporal("o_orderdate"), "o_orderpriority": _text("o_orderpriority")}


@query(_sql("orders", **_ALL))
def checksum_all_orders(spark, sf):
    return checksums(orders(spark, sf))


@query(f"WITH {_OLD} SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM old) AS right_rows")
def level1_row_count(spark, sf):
    return orders(spark, sf).agg(F.count("*").alias("left_rows")).crossJoin(old_orders(spark, sf).agg(F.count("*").alias("right_rows")))  # one row each


@query("SELECT * FROM (VALUES ('missing', 'o_custkey'), ('surplus', 'extra'), ('reordered', '')) AS v(kind, name)")
def level2_columns(spark, sf):
    right = orders(spark, sf).select("o_orderstatus", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", F.lit(1).alias("extra"))
    return spark.createDataFrame([(d.kind, d.column) for d in cmp.column_differences(COLS, right.columns)], "kind string, name string")


@query("SELECT 'type' AS kind, 'o_custkey' AS name, 'bigint' AS l, 'string' AS r")
def level3_types(spark, sf):
    found = cmp.type_differences(orders(spark, sf), orders(spark, sf).withColumn("o_custkey", F.col("o_custkey").cast("string")))
    return spark.createDataFrame([(d.kind, d.column, d.left, d.right) for d in found], "kind string, name string, l string, r string")


@query(f"WITH {_OLD}, a AS ({_sql('orders', **_ALL)}), b AS ({_sql('old', **_ALL)}) SELECT a.\"column\", a.measure, a.value AS \"left\", b.value AS \"right\" FROM a JOIN b ON a.\"column\" = b.\"column\" AND a.measure = b.measure WHERE a.value IS DISTINCT FROM b.value")
def level4_checksums(spark, sf):
    return cmp.checksum_differences(orders(spark, sf), old_orders(spark, sf), COLS)


_ROWS = f"""{_OLD}, l AS (SELECT o.*, {_HASH} AS h FROM orders o), r AS (SELECT o.*, {_HASH} AS h, CASE WHEN o_orderkey % 21 = 0 THEN 'stale' ELSE {_HASH} END AS sh FROM old o),
x AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.h IS NOT NULL AS in_left, r.h IS NOT NULL AS in_right, l.h IS NOT NULL AND r.h IS NOT NULL AND l.h <> r.sh AS stored_differs, l.h IS NOT NULL AND r.h IS NOT NULL AND l.h <> r.h AS content_differs FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey)"""


def _rows(spark, sf):
    left, right = (x.withColumn("row_hash", row_hash(x, COLS)) for x in (orders(spark, sf), old_orders(spark, sf)))
    right = right.withColumn("row_hash", F.when(F.col("o_orderkey") % 21 == 0, "stale").otherwise(F.col("row_hash")))
    return cmp.row_status(left, right, ["o_orderkey"], COLS, "row_hash")


@query(f"WITH {_ROWS} SELECT * FROM x")
def level5_rows(spark, sf):
    return _rows(spark, sf)


@query(f"WITH {_ROWS} SELECT count(*) FILTER (in_left AND NOT in_right) AS only_left, count(*) FILTER (in_right AND NOT in_left) AS only_right, count(*) FILTER (stored_differs) AS stored_differs, count(*) FILTER (content_differs) AS content_differs, count(*) FILTER (content_differs AND NOT stored_differs) AS hidden_differs FROM x")
def row_level_counts(spark, sf):
    return cmp.row_counts(_rows(spark, sf))


@query(f"WITH {_ROWS}, k AS (SELECT CASE WHEN NOT in_right THEN 'only_left' WHEN NOT in_left THEN 'only_right' WHEN content_differs THEN 'content' WHEN stored_differs THEN 'stored' END AS kind, o_orderkey FROM x) SELECT kind, o_orderkey FROM k WHERE kind IS NOT NULL ORDER BY kind, o_orderkey LIMIT 20")
def row_level_samples(spark, sf):
    return cmp.row_samples(_rows(spark, sf), ["o_orderkey"])


@query("SELECT 0::BIGINT AS checksum_differences, count(*) FILTER (o_orderkey IN (2, 3)) AS rows_differ FROM orders")
def values_swapped_detected(spark, sf):
    """Two rows exchange a value: every column's checksum is the same, the rows are not."""
    left = orders(spark, sf).withColumn("v", F.col("o_orderkey"))
    right = left.withColumn("v", F.when(F.col("o_orderkey") == 2, 3).when(F.col("o_orderkey") == 3, 2).otherwise(F.col("v")).cast("bigint"))
    n = cmp.checksum_differences(left, right, left.columns).agg(F.count("*").alias("checksum_differences"))
    return n.crossJoin(cmp.row_status(left, right, ["o_orderkey"], left.columns).agg(F.count_if("content_differs").alias("rows_differ")))  # one row each


@query("SELECT count(*) AS n, 0::BIGINT AS differ FROM orders")
def perturb_and_repair(spark, sf):
    """After a hash comparison every live row of the disturbed target is the source's."""
    out = st.hash_diff(orders(spark, sf), old_target(spark, sf), LoadSettings(method="hash", key="o_orderkey"), NOW).target
    live = align(out.where("NOT _deleted_in_source"), COLS)
    return cmp.row_status(orders(spark, sf), live, ["o_orderkey"], COLS).agg(F.count("*").alias("n"), F.count_if(F.col("content_differs") | ~F.col("in_left") | ~F.col("in_right")).alias("differ"))
