"""Tables as DataFrames: files, JDBC sources, several sources in one."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import quote
from .types import NCHAR_TYPES

#: Drivers are the deployment's to provide; nothing here loads one.
JDBC_DRIVERS = {"mysql": "com.mysql.cj.jdbc.Driver", "postgres": "org.postgresql.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "firebird": "org.firebirdsql.jdbc.FBDriver"}
DEFAULT_SCHEMA = {"postgres": "public", "mssql": "dbo"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_address(dialect: str, table: str, schema: str | None = None, database: str | None = None) -> str:
    parts = [database if dialect == "mssql" else None, schema or DEFAULT_SCHEMA.get(dialect), table]
    return ".".join(quote(p, dialect) for p in parts if p)


def batch_rows(row_bytes: int, configured: int | None = None, most_bytes: int = 400_000_000, least: int = 1000) -> int:
    """Rows fetched at once: as configured or 10,000, fewer where a batch would exceed most_bytes, never below least
    unless fewer are configured, never more than configured."""
    wanted = configured or 10_000
    return min(wanted, max(least, most_bytes // max(1, row_bytes)))


def column_sql(name: str, source_type: str, dialect: str, convert_nchar: bool = False) -> str:
    """A column of a read, as the source's server is asked for it: two-byte text is converted there if wished."""
    quoted = quote(name, dialect)
    return f"CONVERT(VARCHAR(MAX), {quoted}) AS {quoted}" if convert_nchar and dialect == "mssql" and source_type.lower() in NCHAR_TYPES else quoted


def select_sql(table: str, types: Mapping[str, str], dialect: str, where: str | None = None, order_by: str | None = None, convert_nchar: bool = False) -> str:
    """The statement of a read, for the option `query`: columns in their order, the condition, and the order of a read that resumes."""
    columns = ", ".join(column_sql(c, t, dialect, convert_nchar) for c, t in types.items())
    return f"SELECT {columns} FROM {table}" + (f" WHERE ({where})" if where else "") + (f" ORDER BY {quote(order_by, dialect)}" if order_by else "")


def jdbc_options(dialect: str, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, fetch_rows: int = 10_000, schema: str | None = None, database: str | None = None) -> dict[str, str]:
    """Options of spark.read.format("jdbc"): fixed ranges of the key make a read that is parallel and can be
    repeated, range by range, when a task fails."""
    out = {"url": url, "driver": JDBC_DRIVERS[dialect], "dbtable": table_address(dialect, table, schema, database), "fetchsize": str(fetch_rows)}
    if dialect == "mysql":
        out["sessionInitStatement"] = "SET SESSION net_write_timeout = 3600"
    if key and bounds:
        out |= {"partitionColumn": quote(key, dialect), "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def read_jdbc(spark: SparkSession, dialect: str, url: str, table: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(dialect, url, table, **kw)).load()


def fan_in(sources: Mapping[str, DataFrame], label: str = "_source") -> DataFrame:
    """All sources' rows with their label; columns by name, absent ones NULL."""
    labelled = [df.withColumn(label, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def select_columns(columns: list[str], only: list[str] | None = None, exclude: list[str] = (), required: list[str] = ()) -> list[str]:
    """Selected and required columns in the source's order, less those excluded and not required; none left is an error."""
    need = {c.lower() for c in required}
    keep = {c.lower() for c in only} | need if only else {c.lower() for c in columns}
    drop = {c.lower() for c in exclude} - need
    out = [c for c in columns if c.lower() in keep and c.lower() not in drop]
    if not out:
        raise ValueError("no column is left to read")
    return out


def project(df: DataFrame, columns: list[str], where: str | Column | None = None, surrogate: tuple[str, str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """SELECT of a read: filter, surrogate key (alias, expression), columns, new names. Filter and columns reach the scan."""
    if where is not None:
        df = df.where(where)
    if surrogate:
        df = df.withColumn(surrogate[0], F.expr(surrogate[1]))
        columns = [surrogate[0], *columns]
    return df.select(*[f"`{c}`" for c in columns]).withColumnsRenamed(dict(rename or {}))
