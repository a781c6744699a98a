"""Predicates of incremental loads and the cutoffs in them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesce_window(updated: Column, created: Column | None, since: str, zero: str | None = None) -> Column:
    """The row's time of change, or of creation where that is missing or the zero date, is not before since."""
    changed = F.nullif(updated, F.lit(zero)) if zero is not None else updated
    if created is None:
        return (updated >= F.lit(since)) & (changed >= F.lit(since)) if zero is not None else changed >= F.lit(since)
    # the first condition follows from the second, and unlike it reaches the scan
    return ((updated >= F.lit(since)) | (created >= F.lit(since))) & (F.coalesce(changed, created) >= F.lit(since))


def either_window(a: Column, b: Column, since: object) -> Column:
    """Either column, missing counting as 0, is not below since. Not the same as coalesce_window."""
    return (F.coalesce(a, F.lit(0)) >= F.lit(since)) | (F.coalesce(b, F.lit(0)) >= F.lit(since))


def above_watermark(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows above the target's greatest key; all rows where it has none. The mark is one value, read first, so that
    the filter is on a literal and reaches the scan."""
    mark = target.agg(F.max(F.col(f"`{key}`"))).first()[0]
    return source if mark is None else source.where(F.col(f"`{key}`") > F.lit(mark))


def children_of(children: DataFrame, parents: DataFrame, foreign_key: str, parent_key: str, in_window: Column) -> DataFrame:
    return children.join(parents.where(in_window).select(F.col(parent_key).alias(foreign_key)), foreign_key, "left_semi").select(*children.columns)


def with_keys(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key, as text, is among keys (k)."""
    return source.join(keys.select("k"), F.coalesce(F.col(key).cast("string"), F.lit("")) == F.col("k"), "left_semi")


def after_key(key: Column, last: object, where: Column | None = None) -> Column:
    """Restart point of an ordered read."""
    return key > F.lit(last) if where is None else (key > F.lit(last)) & where


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def day_number(c: Column) -> Column:
    """Days since 1899-12-30."""
    return F.datediff(c.cast("date"), F.lit("1899-12-30").cast("date"))


def cutoff(now: datetime, lookback_hours: float | None = None, days_back: int | None = None, deep: bool = False) -> datetime:
    """The window's first day, at midnight: hours back if given and not 0; else, deep, 1 January of this year from
    July on and of last year before; else days back, 14 if not given or 0."""
    if not lookback_hours and deep:
        return datetime(now.year if now.month >= 7 else now.year - 1, 1, 1)
    day = now - (timedelta(hours=lookback_hours) if lookback_hours else timedelta(days=days_back or 14))
    return day.replace(hour=0, minute=0, second=0, microsecond=0)


def cutoff_value(since: datetime, dialect: str) -> str | int:
    """A cutoff as the dialect's columns hold it: days since 1899-12-30 for Firebird, text for others."""
    return (since - datetime(1899, 12, 30)).days if dialect == "firebird" else since.strftime("%Y-%m-%d %H:%M:%S")


def literal(value: object, dialect: str = "postgres") -> str:
    """A value in a dialect's SQL: numbers bare, text in doubled apostrophes; MySQL doubles backslashes too."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(value)
    text = str(value).replace("'", "''")
    return "'" + (text.replace("\\", "\\\\") if dialect == "mysql" else text) + "'"


def quote(name: str, dialect: str = "postgres") -> str:
    if dialect == "mysql":
        return "`" + name.replace("`", "``") + "`"
    if dialect == "mssql":
        return "[" + name.replace("]", "]]") + "]"
    if dialect == "firebird" and name == name.lower():
        name = name.upper()
    return '"' + name.replace('"', '""') + '"'
