"""Snapshot diff: source and target compared by key and row hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import key_text, row_hash

#: Reseed limits: the share of changed rows from which a target without a match is loaded anew.
RESEED_SHARE = 0.95


def snapshot(df: DataFrame, key: str, columns: list[str] | None = None, hash_column: str | None = None) -> DataFrame:
    """(k, h): key as text, and the row's hash, computed from columns or taken from hash_column."""
    h = F.col(hash_column) if hash_column else row_hash(df, columns or df.columns)
    return df.select(key_text(F.col(key)).alias("k"), h.alias("h"))


def differs(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(k, source_hash, target_hash, status) for every key of either snapshot: added, changed, matched or
    deleted. One shuffle of two narrow columns a side."""
    s = source.select(F.col("k").alias("sk"), F.col("h").alias("source_hash"))
    t = target.select(F.col("k").alias("tk"), F.col("h").alias("target_hash"))
    status = F.when(F.col("tk").isNull(), "added").when(F.col("sk").isNull(), "deleted").when(differs(F.col("source_hash"), F.col("target_hash")), "changed").otherwise("matched")
    joined = s.join(t, F.col("sk") == F.col("tk"), "full_outer")
    return joined.select(F.coalesce("sk", "tk").alias("k"), "source_hash", "target_hash", status.alias("status"))


def counts(status: DataFrame) -> DataFrame:
    """One row: added, changed, matched, deleted, source_rows."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(n("added"), n("changed"), n("matched"), n("deleted"), F.count_if(F.col("status") != "deleted").alias("source_rows"))


def changed_keys(status: DataFrame) -> DataFrame:
    return status.where(F.col("status").isin("added", "changed")).select("k", "status")


def precheck(target: DataFrame | None, key: str, hash_column: str, ignore_hash: bool = False) -> str | None:
    """Why a hash comparison is not possible, or None. One aggregate over one column of the target."""
    if ignore_hash:
        return "ignore_hash"
    if target is None:
        return "target_missing"
    if key not in target.columns:
        return "key_column_missing"
    if hash_column not in target.columns:
        return "hash_column_missing"
    rows, hashed = target.agg(F.count("*"), F.count(hash_column)).first()
    return "target_empty" if not rows else "hash_all_null" if not hashed else None


def precheck_frame(target: DataFrame, hash_column: str) -> DataFrame:
    """rows, null_hashes and the reason as a one-row frame."""
    a = target.agg(F.count("*").alias("target_rows"), F.count_if(F.col(hash_column).isNull()).alias("null_hashes"))
    reason = F.when(F.col("target_rows") == 0, "target_empty").when(F.col("target_rows") == F.col("null_hashes"), "hash_all_null")
    return a.withColumn("reason", F.coalesce(reason, F.lit("none")))


def reseed_decision(status: DataFrame, target: DataFrame, hash_column: str) -> DataFrame:
    """Whether the difference is so large that a full load is due: nearly all changed and none matched,
    or as many new and changed rows as the target has while some of its hashes are missing."""
    t = target.agg(F.count("*").alias("target_rows"), F.count_if(F.col(hash_column).isNull()).alias("null_hashes"))
    both = counts(status).crossJoin(t)  # one row each
    all_changed = (F.col("changed") >= F.col("target_rows") * RESEED_SHARE) & (F.col("matched") == 0) & (F.col("target_rows") > 0)
    unhashed = (F.col("added") + F.col("changed") >= F.col("target_rows")) & (F.col("null_hashes") > 0)
    return both.select("added", "changed", "matched", "target_rows", "null_hashes", (all_changed | unhashed).alias("reseed"))
