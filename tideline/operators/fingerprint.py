"""Fingerprints: one aggregate that tells whether a source slice may have changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint_columns(key: str | None = None, stamp: str | None = None, sums: Sequence[str] = ()) -> list[Column]:
    """row_count, max_id, max_ts and agg: the exact decimal sum of the named columns; absent parts are NULL."""
    total = F.lit(None).cast("decimal(38,6)")
    if sums:
        total = None
        for c in sums:
            part = F.coalesce(F.sum(F.col(c).cast("decimal(28,6)")), F.lit(0)).cast("decimal(38,6)")
            total = part if total is None else (total + part).cast("decimal(38,6)")
    return [
        F.count("*").alias("row_count"),
        (F.max(F.col(key)).cast("string") if key else F.lit(None).cast("string")).alias("max_id"),
        (F.date_format(F.max(F.col(stamp)), "yyyy-MM-dd'T'HH:mm:ss") if stamp else F.lit(None).cast("string")).alias("max_ts"),
        total.alias("agg"),
    ]


def fingerprint_key() -> Column:
    """The four parts joined by a pipe, missing ones empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("row_count", "max_id", "max_ts", "agg")]
    return F.concat_ws("|", *parts)


def fingerprint(df: DataFrame, key: str | None = None, stamp: str | None = None, sums: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each slice, with the parts and the fingerprint; map-side combined."""
    out = df.groupBy(*by).agg(*fingerprint_columns(key, stamp, sums))
    return out.withColumn("fingerprint", fingerprint_key())


def unchanged_slices(now: DataFrame, before: DataFrame, target: DataFrame, label: str = "_source") -> DataFrame:
    """Slices that may be skipped: the same fingerprint as before, and the target still holds rows."""
    held = target.select(label).distinct()
    same = now.join(before.select(label, F.col("fingerprint").alias("_before")), label).where(F.col("fingerprint") == F.col("_before"))
    return same.join(held, label, "left_semi").select(label, "fingerprint")
