"""Target partitioning by value or period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("list", "range_day", "range_month", "range_year")
DEFAULT = "default"


@dataclass(frozen=True)
class PartitionSpec:
    column: str
    mode: str = "list"
    default_partition: bool = True


def parse_spec(value: str | dict | None, legacy_by_source: bool = False) -> PartitionSpec | None:
    """None, a column name, or a mapping with column, mode and default_partition."""
    if value is None:
        return PartitionSpec("_source") if legacy_by_source else None
    if isinstance(value, str):
        return PartitionSpec(value)
    mode = value.get("mode", "list")
    if mode not in MODES:
        raise ValueError(f"partition mode {mode!r} is not one of {', '.join(MODES)}")
    if not value.get("column"):
        raise ValueError("a partition needs a column")
    return PartitionSpec(value["column"], mode, bool(value.get("default_partition", True)))


def bounds(c: Column, mode: str) -> tuple[Column, Column]:
    """First day of the period and of the next."""
    unit = mode.removeprefix("range_")
    day = c.cast("date")
    if unit == "day":
        return day, F.date_add(day, 1)
    start = F.trunc(day, unit)
    return start, F.add_months(start, 1 if unit == "month" else 12)


def suffix(c: Column, mode: str) -> Column:
    """Names a row's partition; NULL: the default partition."""
    if mode == "list":
        text = F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), "[^0-9a-z]+", "_"), "^_+|_+$", "")
        return F.when(text == "", "x").otherwise(text)
    return F.date_format(c.cast("date"), {"range_day": "yyyy_MM_dd", "range_month": "yyyy_MM", "range_year": "yyyy"}[mode])


def route(df: DataFrame, spec: PartitionSpec, name: str = "_partition") -> DataFrame:
    """Adds each row's partition. Without a default partition a NULL key fails."""
    s = suffix(F.col(spec.column), spec.mode)
    other = F.lit(DEFAULT) if spec.default_partition else F.raise_error(F.lit(f"no partition for a NULL {spec.column}")).cast("string")
    return df.withColumn(name, F.coalesce(s, other))


def discover(df: DataFrame, spec: PartitionSpec) -> DataFrame:
    """Partitions that staged rows need, from their distinct values, with bounds for periods."""
    c = F.col(spec.column)
    if spec.mode == "list":
        return df.where(c.isNotNull()).select(suffix(c, spec.mode).alias("suffix"), c.cast("string").alias("value")).distinct()
    lo, hi = bounds(c, spec.mode)
    return df.where(c.isNotNull()).select(suffix(c, spec.mode).alias("suffix"), lo.alias("from_date"), hi.alias("to_date")).distinct()


def effective_spec(wanted: PartitionSpec | None, target_exists: bool, target_column: str | None) -> tuple[PartitionSpec | None, str | None]:
    """What holds: a missing target takes the wanted one; a plain target stays plain, with a warning; another key fails."""
    if wanted is None or not target_exists:
        return wanted, None
    if target_column is None:
        return None, "the target exists without partitions and stays so"
    if target_column != wanted.column:
        raise ValueError(f"the target is partitioned by {target_column}, not {wanted.column}")
    return wanted, None


def unique_key(keys: list[str], spec: PartitionSpec | None) -> list[str]:
    """A unique key of a partitioned target holds the partition's column."""
    return keys if spec is None or spec.column in keys else [*keys, spec.column]
