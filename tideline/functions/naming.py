"""Names of columns, indexes and partitions."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def column_mapping_name(name: str) -> str:
    """Lower case, white space to one underscore, other signs dropped, underscores single and not at the ends."""
    text = re.sub(r"\s+", "_", name.lower())
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "", text)).strip("_")


def column_mapping_expr(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", "_"), r"(?U)[^\w]", "")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_+|_+$", "")


def clean_name(name: str) -> str:
    """Signs to underscores, a prefix before a leading digit, lower case."""
    text = re.sub(r"\W", "_", re.sub('[﻿"$\n\r\t]', "", name))
    return (f"letter_{text}" if text[:1].isdigit() else text).lower()


def clean_name_expr(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(c, '[﻿"$\n\r\t]', ""), r"(?U)\W", "_")
    return F.lower(F.when(text.rlike("^[0-9]"), F.concat(F.lit("letter_"), text)).otherwise(text))


def sql_keywords(spark: SparkSession) -> frozenset[str]:
    """The default reserved words: those that Spark's own SQL grammar names."""
    return frozenset(r[0].upper() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect())


def prefix_reserved(name: str, reserved: Iterable[str]) -> str:
    """An underscore before a reserved word. reserved: a list the deployment freezes, in upper case."""
    return f"_{name}" if name.upper() in reserved else name


def target_column_names(columns: Sequence[str], reserved: Iterable[str], hash_column: str = "row_hash") -> tuple[dict[str, str], list[str]]:
    """Source to target names, and the target's order: source columns, hash, stamp, deletion flag.
    Two columns with one name fail; a managed name that the source has keeps its place."""
    reserved = frozenset(reserved)
    names: dict[str, str] = {}
    for c in columns:
        new = prefix_reserved(clean_name(column_mapping_name(c)), reserved)
        if new in names.values():
            raise ValueError(f"column {c!r} and another both become {new!r}")
        names[c] = new
    order = list(names.values())
    return names, order + [m for m in (hash_column, "_timestamp", "_deleted_in_source") if m not in order]


def reconcile_order(existing: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The target's order for the columns it has; new ones at the end."""
    return [c for c in existing if c in set(wanted)] + [c for c in wanted if c not in set(existing)]


def short_name(base: str, digest: str, limit: int = 63) -> str:
    return base if len(base) <= limit else f"{base[: limit - len(digest) - 1]}_{digest}"


def index_name(table: str, columns: Sequence[str]) -> str:
    base = f"ux_{table}_{'_'.join(columns)}"
    return short_name(base, uuid.uuid5(uuid.NAMESPACE_OID, base).hex[:8])


def partition_name(table: str, suffix: str) -> str:
    base = f"{table}_{suffix}"
    return short_name(base, hashlib.sha1(base.encode()).hexdigest()[:8])


def slug(value: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", value.lower()).strip("_") or "x"
