"""Cleaning, names, types and partitions: recorded answers for a battery of values, and rules over derived dirty columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as c
from ..functions import naming as n
from ..operators import partitions as pt
from ..operators import statistics as stats
from ..operators.merge import adopt_new_columns, upsert
from ..sources import types as ty
from ..sources.tables import read_table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Recorded answers: value, integer, text, truth, date, date and time. None is NULL.
BATTERY = [
    ("42", 42, "42", None, None, None),
    (" 42 ", 42, " 42 ", None, None, None),
    ("007", 7, "007", None, None, None),
    ("+5", 5, "+5", None, None, None),
    ("3.5", None, "3.5", None, None, None),
    ("-3.5", None, "-3.5", None, None, None),
    ("3,5", None, "3,5", None, None, None),
    ("1e3", 1000, "1e3", None, None, None),
    ("1_000", 1000, "1_000", None, None, None),
    ("", None, None, None, None, None),
    ("  ", None, None, None, None, None),
    ("nan", None, None, None, None, None),
    ("NaN", None, None, None, None, None),
    ("none", None, "none", None, None, None),
    ("None", None, "None", None, None, None),
    ("null", None, "null", None, None, None),
    ("NULL", None, "NULL", None, None, None),
    ("true", None, "true", True, None, None),
    ("yes", None, "yes", True, None, None),
    ("ano", None, "ano", True, None, None),
    ("t", None, "t", True, None, None),
    (" ano ", None, " ano ", True, None, None),
    ("T", None, "T", True, None, None),
    ("false", None, "false", False, None, None),
    ("no", None, "no", False, None, None),
    ("ne", None, "ne", False, None, None),
    ("f", None, "f", False, None, None),
    ("1", 1, "1", True, None, None),
    ("0", 0, "0", False, None, None),
    ("y", None, "y", None, None, None),
    ("n", None, "n", None, None, None),
    ("mozna", None, "mozna", None, None, None),
    ("2026-08-07", None, "2026-08-07", None, "2026-08-07", "2026-08-07 00:00:00"),
    ("  2026-08-07  ", None, "  2026-08-07  ", None, "2026-08-07", "2026-08-07 00:00:00"),
    ("2026-08-07 12:34:56", None, "2026-08-07 12:34:56", None, "2026-08-07", "2026-08-07 12:34:56"),
    ("2026-08-07T12:34:56", None, "2026-08-07T12:34:56", None, "2026-08-07", "2026-08-07 12:34:56"),
    ("07/08/2026", None, "07/08/2026", None, "2026-07-08", "2026-07-08 00:00:00"),
    ("1900-01-01", None, "1900-01-01", None, "1900-01-01", "1900-01-01 00:00:00"),
    ("0000-00-00", None, "0000-00-00", None, None, None),
    ("0000-00-00 00:00:00", None, "0000-00-00 00:00:00", None, None, None),
    ("9999-12-31", None, "9999-12-31", None, None, None),
    ("9999-12-31 23:59:59", None, "9999-12-31 23:59:59", None, None, None),
    ("2026-02-30", None, "2026-02-30", None, None, None),
    ("2026-13-45", None, "2026-13-45", None, None, None),
    ("not a date", None, "not a date", None, None, None),
]
TIMES = [("12:34:56", "12:34:56"), ("1:02:03", "1:02:03"), ("25:00:00", "25:00:00"), ("3 days 01:02:03", "01:02:03"), ("-01:00:00", "-1:00:00"), ("abc", None), ("", None)]
NUMBERS = [(3.5, None, "3.5", True), (1.0, 1, "1", True), (8.0, 8, "8", True), (0.0, 0, "0", False), (-1.0, -1, "-1", True), (0.5, None, "0.5", False), (float("nan"), None, None, None), (None, None, None, None)]
CLOCK = [(3600.0, "01:00:00"), (0.0, "00:00:00"), (-60.0, "-1:59:00"), (3661.7, "01:01:01")]


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "'nan'::DOUBLE" if v != v else f"{v!r}::DOUBLE"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS v({names})"


def _battery(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r[0]) for i, r in enumerate(BATTERY)], "i int, v string")


def _by(col: int, name: str, cast: str) -> str:
    return f"SELECT i, v, r::{cast} AS {name} FROM ({_values([(i, r[0], r[col]) for i, r in enumerate(BATTERY)], 'i, v, r')})"


@query(_by(1, "r", "BIGINT::VARCHAR"))
def to_int_or_none(spark, sf):
    return _battery(spark).withColumn("r", c.to_int_or_none(F.col("v")).cast("string"))


@query("SELECT i, d::VARCHAR AS d, r::VARCHAR AS r FROM (VALUES (0, '3.00', 3), (1, '3.50', NULL), (2, '0.00', 0)) AS v(i, d, r)")
def to_int_or_na(spark, sf):
    rows = spark.createDataFrame([(0, "3"), (1, "3.5"), (2, "-0")], "i int, s string").select("i", F.col("s").cast("decimal(5,2)").alias("x"))
    return rows.select("i", F.col("x").cast("string").alias("d"), c.to_int_or_na(F.col("x"), "decimal").cast("string").alias("r"))


@query(_by(2, "r", "VARCHAR"))
def to_str_or_none(spark, sf):
    return _battery(spark).withColumn("r", c.to_str_or_none(F.col("v")))


@query(_by(3, "r", "BOOLEAN"))
def to_bool(spark, sf):
    return _battery(spark).withColumn("r", c.to_bool(F.col("v")))


@query(_by(4, "r", "VARCHAR"))
def to_date_str(spark, sf):
    return _battery(spark).withColumn("r", c.to_date_str(F.col("v")))


@query(_by(5, "r", "VARCHAR"))
def to_datetime_str(spark, sf):
    return _battery(spark).withColumn("r", c.to_datetime_str(F.col("v")))


@query(f"SELECT v, r FROM ({_values(TIMES, 'v, r')})")
def to_time_str(spark, sf):
    return spark.createDataFrame([(v,) for v, _ in TIMES], "v string").withColumn("r", c.to_time_str(F.col("v")))


@query(f"SELECT i, r FROM ({_values([(i, r) for i, (_, r) in enumerate(CLOCK)], 'i, r')})")
def to_time_str_seconds(spark, sf):
    return spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CLOCK)], "i int, v double").select("i", c.to_time_str(F.col("v"), "float").alias("r"))


@query(f"SELECT i, n::BIGINT::VARCHAR AS n, s, b FROM ({_values([(i, *r[1:]) for i, r in enumerate(NUMBERS)], 'i, n, s, b')})")
def numbers_to_int_text_bool(spark, sf):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NUMBERS)], "i int, v double")
    return rows.select("i", c.to_int_or_none(F.col("v"), "float").cast("string").alias("n"), c.to_str_or_none(F.col("v"), "float").alias("s"), c.to_bool(F.col("v"), "float").alias("b"))


@query("SELECT i, v, r::VARCHAR AS r FROM (" + _values([(i, x[0], None if x[1] is None else str(x[1])) for i, x in enumerate(BATTERY)], "i, v, r") + ")")
def fmt_int_for_csv(spark, sf):
    return _battery(spark).withColumn("r", c.fmt_int_for_csv(F.col("v")))


@query(f"SELECT i, v, CASE WHEN d IS NOT NULL THEN trim(v) END AS r FROM ({_values([(i, x[0], x[4]) for i, x in enumerate(BATTERY)], 'i, v, d')})")
def clean_invalid_date(spark, sf):
    return _battery(spark).withColumn("r", c.clean_invalid_date(F.col("v")))


_DIRTY = "x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '0000-00-00' WHEN o_orderkey % 17 = 0 THEN '9999-12-31' WHEN o_orderkey % 19 = 0 THEN '0' WHEN o_orderkey % 23 = 0 THEN 'not a date' WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)"


def _dirty_dates(spark, sf):
    k = F.col("o_orderkey")
    d = F.when(k % 11 == 0, "0000-00-00").when(k % 17 == 0, "9999-12-31").when(k % 19 == 0, "0").when(k % 23 == 0, "not a date").when(k % 29 == 0, "").when(k % 13 == 0, None)
    return read_table(spark, sf, "orders").select("o_orderkey", d.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))


@query(f"WITH {_DIRTY} SELECT o_orderkey, CASE WHEN d LIKE '9999-12-31%' THEN NULL ELSE strftime(try_cast(d AS date), '%Y-%m-%d') END AS d FROM x")
def fix_invalid_dates(spark, sf):
    return _dirty_dates(spark, sf).withColumn("d", c.fix_invalid_dates(F.col("d")))


@query(f"WITH {_DIRTY} SELECT o_orderkey, CASE WHEN d LIKE '9999-12-31%' THEN NULL ELSE strftime(try_cast(d AS date), '%Y-%m-%d %H:%M:%S') END AS d FROM x")
def dirty_to_datetime(spark, sf):
    return _dirty_dates(spark, sf).withColumn("d", c.to_datetime_str(F.col("d")))


@query("SELECT doc_id, md5(replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, chr(10), ' ') END, chr(9), ' ')) AS m FROM documents")
def carriage_returns(spark, sf):
    t, nl = F.col("text"), F.lit("\n")
    dirty = F.when(F.col("doc_id") % 2 == 0, F.replace(t, nl, F.lit("\r\n"))).otherwise(F.replace(t, nl, F.lit("\r")))
    return read_table(spark, sf, "documents").select("doc_id", F.md5(F.encode(F.replace(c.normalize_carriage_returns(dirty), F.lit("\t"), F.lit(" ")), "utf-8")).alias("m"))


@query("SELECT c_custkey, '\\x' || lower(hex(encode(c_name))) AS b FROM customer")
def bytes_to_pg_hex(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", c.bytes_to_hex_literal(F.encode("c_name", "utf-8")).alias("b"))


@query("SELECT event_id, cast(cast(9007199254740992 AS double) - event_id AS bigint) AS v FROM events")
def int_precision_guard(spark, sf):
    return read_table(spark, sf, "events").select("event_id", c.integer_precision_guard(F.lit(9007199254740992.0) - F.col("event_id")).alias("v"))


@query("SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END, '') AS s FROM orders")
def empty_to_null(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", c.empty_to_null(F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus"))).alias("s"))


@query("SELECT o_orderkey, '{' || o_orderstatus || ',' || CASE WHEN o_orderkey % 3 = 0 THEN 'NULL' ELSE cast(o_custkey AS varchar) END || '}' AS a FROM orders")
def array_literal(spark, sf):
    k = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string"))
    return read_table(spark, sf, "orders").select("o_orderkey", c.array_literal(F.array("o_orderstatus", k)).alias("a"))


@query("SELECT c_custkey, replace(c_name, 'Customer', 'Žluťoučký') AS utf8, replace(c_name, 'Customer', 'Žluťoučký') AS cascade, CASE WHEN c_custkey % 2 = 0 THEN 'příliš' ELSE 'žluť' END AS cp1250, 'a' || chr(65533) || 'b' AS broken, hex(encode(c_name)) AS kept FROM customer")
def decode_bytes(spark, sf):
    """Whole columns of bytes: UTF-8, one order of encodings that begins with it, cp1250 first, bytes that UTF-8 lacks, and a
    column whose target holds bytes."""
    named = F.replace("c_name", F.lit("Customer"), F.lit("Žluťoučký"))
    old = {n: F.unhex(F.lit(t.encode("cp1250").hex())) for n, t in (("even", "příliš"), ("odd", "žluť"))}
    t = read_table(spark, sf, "customer").select("c_custkey", F.encode(named, "utf-8").alias("utf8"), F.encode(named, "utf-8").alias("cascade"), F.when(F.col("c_custkey") % 2 == 0, old["even"]).otherwise(old["odd"]).alias("cp1250"), F.unhex(F.lit("61ff62")).alias("broken"), F.encode("c_name", "utf-8").alias("kept"))
    t = t.withColumn("cascade", c.decode_bytes(F.col("cascade"), ("utf-8", "cp1250", "latin-1"))).withColumn("cp1250", c.decode_bytes(F.col("cp1250"), ty.ENCODINGS["mssql"]))
    return c.decode_bytes_columns(t, ty.ENCODINGS["mysql"], ["kept"]).withColumn("kept", F.hex("kept"))


@query("SELECT doc_id, '{\"t\":\"' || array_to_string(list_transform(string_split(regexp_replace(coalesce(lang, ''), '[^a-z]', '', 'g') || 'é😀' || cast(doc_id AS varchar), ''), lambda x: CASE x WHEN 'é' THEN '\\u00e9' WHEN '😀' THEN '\\ud83d\\ude00' ELSE x END), '') || '\"}' AS r FROM documents")
def json_ascii(spark, sf):
    """Characters over ASCII, one of them beyond 16 bits, in JSON of every row."""
    t = F.concat(F.regexp_replace(F.coalesce("lang", F.lit("")), "[^a-z]", ""), F.lit("é😀"), F.col("doc_id").cast("string"))
    return read_table(spark, sf, "documents").select("doc_id", c.to_json_text(F.struct(t.alias("t")), structured=True).alias("r"))


@query("WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_custkey || ' ' WHEN o_orderkey % 7 = 0 THEN '3.5' ELSE cast(o_custkey AS varchar) END AS n, CASE WHEN o_orderkey % 11 = 0 THEN '0000-00-00' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'ano' ELSE 'maybe' END AS b, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END AS t FROM orders) SELECT o_orderkey AS k, CASE WHEN n = '3.5' THEN NULL ELSE trim(n) END AS n, CASE WHEN d = '0000-00-00' THEN NULL ELSE d END AS d, CASE WHEN b = 'ano' THEN true END AS b, CASE WHEN trim(t) <> '' THEN t END AS t, NULL::VARCHAR AS absent, false AS _deleted_in_source, 'now' AS _timestamp FROM x")
def prepare_export(spark, sf):
    k = F.col("o_orderkey")
    rows = read_table(spark, sf, "orders").select(
        k.alias("k"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).when(k % 7 == 0, "3.5").otherwise(F.col("o_custkey").cast("string")).alias("n"),
        F.when(k % 11 == 0, "0000-00-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.when(k % 2 == 0, "ano").otherwise("maybe").alias("b"),
        F.when(k % 5 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("t"),
        F.lit(1).alias("_mage_tmp"),
    )
    return c.prepare_export(rows, {"k": "BIGINT", "n": "BIGINT", "d": "DATE", "b": "BOOLEAN", "t": "TEXT", "absent": "TEXT"}, now="now").withColumn("n", F.col("n").cast("string"))


# --- names ------------------------------------------------------------------------------------------

NAMES = [("Order  No.", "order_no", "order__no_"), ("  Žluťoučký kůň ", "žluťoučký_kůň", "__žluťoučký_kůň_"), ("a--b__c", "ab_c", "a__b__c"), ("1st $value", "1st_value", "letter_1st_value"), ("_x_", "x", "_x_"), ("ID", "id", "id")]


@query(_values([(a, b) for a, b, _ in NAMES], "name, mapped"))
def column_mapping(spark, sf):
    return spark.createDataFrame([(a,) for a, _, _ in NAMES], "name string").withColumn("mapped", n.column_mapping_expr(F.col("name")))


@query(_values([(a, b) for a, _, b in NAMES], "name, cleaned"))
def clean_names(spark, sf):
    return spark.createDataFrame([(a,) for a, _, _ in NAMES], "name string").withColumn("cleaned", n.clean_name_expr(F.col("name")))


@query("SELECT * FROM (VALUES ('order', '_order'), ('select', '_select'), ('price', 'price'), ('type', '_type')) AS v(name, target)")
def reserved_prefix(spark, sf):
    words = frozenset({"ORDER", "SELECT", "TYPE"})
    return spark.createDataFrame([(x, n.prefix_reserved(x, words)) for x in ("order", "select", "price", "type")], "name string, target string")


@query("SELECT * FROM (VALUES (1, 'id'), (2, '_order'), (3, 'unit_price'), (4, 'row_hash'), (5, '_timestamp'), (6, '_deleted_in_source')) AS v(ordinal, name)")
def target_column_names(spark, sf):
    _, order = n.target_column_names(["ID", "Order", "Unit price"], {"ORDER"})
    return spark.createDataFrame(list(enumerate(order, 1)), "ordinal int, name string")


@query("SELECT * FROM (VALUES (1, 'c'), (2, 'a'), (3, 'b'), (4, 'd')) AS v(ordinal, name)")
def reconcile_order(spark, sf):
    return spark.createDataFrame(list(enumerate(n.reconcile_order(["c", "a", "x"], ["a", "b", "c", "d"]), 1)), "ordinal int, name string")


@query("SELECT o_orderkey, o_custkey, NULL::VARCHAR AS o_orderpriority FROM orders")
def missing_columns(spark, sf):
    o = read_table(spark, sf, "orders")
    return adopt_new_columns(o.select("o_orderkey", "o_custkey"), o.select("o_custkey", "o_orderpriority"))


# --- types --------------------------------------------------------------------------------------------


# What each dialect's type names become, written out by target type, apart from the maps that are queried.
_EXPECTED = {
    "mysql": {
        "INTEGER": "int integer smallint mediumint tinyint year", "BIGINT": "bigint", "BOOLEAN": "bit bool boolean", "REAL": "float", "DOUBLE PRECISION": "double,double precision",
        "NUMERIC": "decimal dec numeric fixed", "VARCHAR": "varchar", "TEXT": "char tinytext text mediumtext longtext enum set binary varbinary geometry", "BYTEA": "blob tinyblob mediumblob longblob",
        "DATE": "date", "TIMESTAMP": "datetime timestamp", "TIME": "time", "JSONB": "json",
    },
    "postgres": {
        "INTEGER": "smallint integer int", "BIGINT": "bigint", "BOOLEAN": "boolean", "REAL": "real", "DOUBLE PRECISION": "double precision,", "NUMERIC": "numeric decimal", "VARCHAR": "character varying,", "BYTEA": "bytea",
        "TEXT": "money,character,text,citext,uuid,interval,bit,bit varying,xml,inet,cidr,macaddr,macaddr8,tsvector,tsquery,point,line,lseg,box,path,polygon,circle,array,user-defined,int4range",
        "DATE": "date", "TIMESTAMP": "timestamp without time zone,timestamp with time zone", "TIME": "time without time zone,time with time zone", "JSONB": "json jsonb",
    },
    "mssql": {
        "INTEGER": "int integer smallint tinyint", "BIGINT": "bigint", "BOOLEAN": "bit", "REAL": "real", "DOUBLE PRECISION": "float", "NUMERIC": "decimal numeric money smallmoney", "VARCHAR": "varchar",
        "TEXT": "char nchar nvarchar text ntext binary varbinary image uniqueidentifier xml sql_variant", "DATE": "date", "TIMESTAMP": "datetime datetime2 smalldatetime datetimeoffset", "TIME": "time", "JSONB": "json",
    },
}


def _map_query(dialect: str):
    names = lambda text: [x for x in text.split("," if "," in text else " ") if x]
    pairs = [(n, target) for target, text in _EXPECTED[dialect].items() for n in names(text)]

    def run(spark, sf):
        return spark.createDataFrame([(k,) for k, _ in pairs], "source_type string").withColumn("pg_type", ty.map_type_expr(dialect, F.upper("source_type")))

    run.__name__ = f"type_map_{dialect}"
    return query(_values(pairs, "source_type, pg_type"))(run)


type_map_mysql, type_map_postgres, type_map_mssql = map(_map_query, ("mysql", "postgres", "mssql"))
FB = [(7, 0, 0, "INTEGER"), (8, 0, -2, "NUMERIC"), (16, 0, 0, "BIGINT"), (16, 1, 0, "NUMERIC"), (16, 2, -6, "NUMERIC"), (261, 1, 0, "TEXT"), (261, 0, 0, "BYTEA"), (10, 0, 0, "REAL"), (27, 0, 0, "DOUBLE PRECISION"), (12, 0, 0, "DATE"), (13, 0, 0, "TIME"), (35, 0, 0, "TIMESTAMP"), (23, 0, 0, "BOOLEAN"), (14, 0, 0, "TEXT"), (37, 0, 0, "VARCHAR"), (7, 0, -1, "NUMERIC"), (8, 0, 0, "INTEGER"), (16, 0, -3, "NUMERIC"), (99, 0, 0, "TEXT")]


@query(_values(FB, "code, subtype, scale, pg_type"))
def fb_type_map(spark, sf):
    rows = spark.createDataFrame([r[:3] for r in FB], "code int, subtype int, scale int")
    return rows.withColumn("pg_type", ty.firebird_type_expr(F.col("code"), F.col("subtype"), F.col("scale")))


@query("SELECT * FROM (VALUES ('p_partkey', 'bigint', 1), ('p_name', 'string', 2), ('p_brand', 'string', 3), ('p_type', 'string', 4), ('p_size', 'int', 5), ('p_retailprice', 'double', 6)) AS v(name, type, ordinal)")
def introspect_columns(spark, sf):
    return spark.createDataFrame([(a, b, d) for a, b, _, d in ty.describe(read_table(spark, sf, "part"))], "name string, type string, ordinal int")


@query("SELECT 'rows' AS measure, count(*) AS n FROM lineitem UNION ALL SELECT 'declared', 78")
def estimate_size(spark, sf):
    rows, _ = stats.size_estimate(read_table(spark, sf, "lineitem"))
    return spark.createDataFrame([("rows", rows), ("declared", stats.declared_width([("varchar", None), ("char", 20), ("int", None)]))], "measure string, n long")


@query("SELECT 'o_orderkey' AS column, CASE WHEN max(o_orderkey) <= 32767 THEN 'smallint' ELSE 'integer' END AS pg_type FROM orders UNION ALL SELECT 'big', 'bigint' UNION ALL SELECT 'o_orderstatus', 'text' UNION ALL SELECT 'price', 'double precision' UNION ALL SELECT 'nothing', 'text'")
def int_width_inference(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") + 2147483648).alias("big"), "o_orderstatus", (F.col("o_totalprice") + 0.5).alias("price"), F.lit(None).cast("string").alias("nothing"))
    return stats.suggest_types(stats.column_statistics(o, o.columns))


@query("SELECT 'small' AS column, 'INTEGER' AS pg_type UNION ALL SELECT 'large', 'BIGINT' UNION ALL SELECT 'flag', 'BOOLEAN' UNION ALL SELECT 'many', 'TEXT'")
def promote_types(spark, sf):
    k = F.col("o_orderkey")
    o = read_table(spark, sf, "orders").select(k.alias("small"), (k + 1932735282).alias("large"), (k % 2).cast("string").alias("flag"), (k % 3).cast("string").alias("many"))
    return stats.promote(o, ["small", "large"], ["flag", "many"])


_STATS = "count(*) FILTER ({c} IS NULL) AS nulls, count({c}) AS n, count(try_cast({c} AS bigint)) AS integers, 0::BIGINT AS floats, count(*) FILTER ({c} IS NOT NULL AND try_cast({c} AS double) IS NULL) AS non_numeric, min(try_cast({c} AS bigint)) AS int_min, max(try_cast({c} AS bigint)) AS int_max"


@query("WITH x AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_custkey AS varchar) END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE cast(o_orderkey AS varchar) END AS b FROM orders) SELECT 'a' AS column, " + _STATS.format(c="a") + " FROM x UNION ALL SELECT 'b', " + _STATS.format(c="b") + " FROM x")
def column_stats(spark, sf):
    k = F.col("o_orderkey")
    o = read_table(spark, sf, "orders").select(F.when(k % 13 != 0, F.col("o_custkey").cast("string")).alias("a"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(k.cast("string")).alias("b"))
    return stats.column_statistics(o, ["a", "b"])


@query("SELECT * FROM (VALUES ('pk', true, 1, 'o_orderkey'), ('wide', false, 1, 'o_orderdate'), ('wide', false, 2, 'o_custkey')) AS v(index, is_primary, position, \"column\")")
def catalog_keys(spark, sf):
    """Keys of a catalog made of orders' own schema: a primary key, a unique index over two columns, one over a column that may
    be NULL, one that is not unique."""
    names = read_table(spark, sf, "orders").columns
    at = {n: i for i, n in enumerate(names, 1)}
    columns = spark.createDataFrame([(i, n, n == "o_orderstatus") for n, i in at.items()], "number int, column string, nullable boolean")
    given = [("pk", True, True, ["o_orderkey"]), ("wide", True, False, ["o_orderdate", "o_custkey"]), ("open", True, False, ["o_custkey", "o_orderstatus"]), ("plain", False, False, ["o_custkey"])]
    indexes = spark.createDataFrame([(n, u, p, [at[c] for c in cs]) for n, u, p, cs in given], "index string, is_unique boolean, is_primary boolean, numbers array<int>")
    return stats.index_columns(indexes, columns)


@query("SELECT c_custkey, 'příliš a-o-b ?' || cast(c_custkey AS varchar) AS r, c_name AS plain FROM customer")
def nchar_narrowed(spark, sf):
    """Letters of the code page stay, one has a base letter, one has none."""
    t = read_table(spark, sf, "customer")
    return t.select("c_custkey", c.narrow_text(F.concat(F.lit("příliš a-ø-b Ж"), F.col("c_custkey").cast("string"))).alias("r"), c.narrow_text(F.col("c_name")).alias("plain"))


@query("SELECT o_orderkey, cast(o_custkey AS varchar) AS a, cast(o_custkey AS varchar) AS b, o_custkey AS c, cast(o_custkey AS varchar) AS d, o_custkey AS e, o_custkey AS f FROM orders")
def text_dtypes(spark, sf):
    """A number under a type that a dialect reads as text, and under one that only another does."""
    k = F.col("o_custkey")
    o = read_table(spark, sf, "orders").select("o_orderkey", *[k.alias(x) for x in "abcdef"])
    for dialect, types in (("mysql", {"a": "VARBINARY"}), ("postgres", {"b": "citext", "c": "varchar"}), ("mssql", {"d": "ntext", "e": "uniqueidentifier"}), ("firebird", {"f": "37"})):
        o = ty.as_text(o, types, dialect)
    return o


@query('SELECT r_regionkey AS "R_REGIONKEY", r_name AS "R_NAME" FROM region')
def restore_case(spark, sf):
    return ty.restore_case(read_table(spark, sf, "region"), ["R_REGIONKEY", "R_NAME"])


# --- partitions -----------------------------------------------------------------------------------------


def _bounds_query(mode: str, lo: str, hi: str):
    def run(spark, sf):
        a, b = pt.bounds(F.col("o_orderdate"), mode)
        text = lambda x: F.date_format(x, "yyyy-MM-dd")
        return read_table(spark, sf, "orders").select(text(a).alias("from_date"), text(b).alias("to_date")).distinct()

    run.__name__ = f"period_bounds_{mode.removeprefix('range_')}"
    return query(f"SELECT DISTINCT strftime({lo}, '%Y-%m-%d') AS from_date, strftime({lo} + INTERVAL 1 {hi}, '%Y-%m-%d') AS to_date FROM orders")(run)


period_bounds_day = _bounds_query("range_day", "cast(o_orderdate AS date)", "DAY")
period_bounds_month = _bounds_query("range_month", "date_trunc('month', o_orderdate)", "MONTH")
period_bounds_year = _bounds_query("range_year", "date_trunc('year', o_orderdate)", "YEAR")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE regexp_replace(regexp_replace(lower(o_orderpriority), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') END AS by_list, strftime(o_orderdate, '%Y_%m_%d') AS by_day, strftime(o_orderdate, '%Y_%m') AS by_month, strftime(o_orderdate, '%Y') AS by_year FROM orders")
def partition_suffix(spark, sf):
    d = F.col("o_orderdate")
    return read_table(spark, sf, "orders").select("o_orderkey", pt.suffix(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")), "list").alias("by_list"), pt.suffix(d, "range_day").alias("by_day"), pt.suffix(d, "range_month").alias("by_month"), pt.suffix(d, "range_year").alias("by_year"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y_%m') AS suffix, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS from_date, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS to_date FROM orders WHERE o_orderkey % 13 <> 0")
def partition_discovery(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")))
    found = pt.discover(o, pt.parse_spec({"column": "o_orderdate", "mode": "range_month"}))
    return found.select("suffix", *[F.date_format(x, "yyyy-MM-dd").alias(x) for x in ("from_date", "to_date")])


@query("SELECT p, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'default' ELSE strftime(o_orderdate, '%Y') END AS p FROM orders) GROUP BY p")
def default_partition_rows(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")))
    return pt.route(o, pt.PartitionSpec("o_orderdate", "range_year"), "p").groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT strftime(CASE WHEN o_orderkey % 10 = 3 THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END, '%Y_%m') AS p, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1")
def partition_move_on_upsert(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    moved = o.where("o_orderkey % 10 = 3").withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 40 DAY"))
    out = pt.route(upsert(o, moved, ["o_orderkey"]), pt.PartitionSpec("o_orderdate", "range_month"), "p")
    return out.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))
