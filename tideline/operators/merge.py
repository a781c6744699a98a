"""The next state of a target, as DataFrame algebra. Nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_text
from ..functions.naming import reconcile_order


class DuplicateKeys(ValueError):
    """A key that must be unique occurs more than once."""


def align(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """The target's columns in its order: matched without regard to case, then `_x` by `x`; absent ones are NULL,
    others are dropped."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for c in columns:
        name = have.get(c.lower()) or (have.get(c[1:].lower()) if c.startswith("_") else None)
        x = F.col(f"`{name}`") if name else F.lit(None)
        out.append((x.cast(types[c]) if types and c in types else x).alias(c))
    return df.select(*out)


def adopt_new_columns(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target with the source's new columns at its end, NULL so far."""
    types = dict(source.dtypes)
    order = reconcile_order(target.columns, source.columns)
    order = target.columns + [c for c in order if c not in target.columns]
    return target.select(*[F.col(f"`{c}`") if c in target.columns else F.lit(None).cast(types[c]).alias(c) for c in order])


def ensure_managed(target: DataFrame, hash_column: str = "row_hash", flag: str = "_deleted_in_source", stamp: str = "_timestamp") -> DataFrame:
    """The target with the managed columns it lacks at its end: hash and stamp NULL, the flag false."""
    new = {hash_column: F.lit(None).cast("string"), stamp: F.lit(None).cast("string"), flag: F.lit(False)}
    return target.withColumns({c: x for c, x in new.items() if c not in target.columns})


def upsert(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged rows replace or join the target's by key. Only the key's columns take part in the
    shuffle's condition; the target's side keeps all columns, once."""
    kept = target.join(staged.select(*[F.col(f"`{k}`") for k in keys]), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(align(staged, target.columns, dict(target.dtypes)))


def replace_by_key(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete by key, then insert: a row may move to another partition of the target."""
    return upsert(target, staged, keys)


def replace_slice(target: DataFrame, staged: DataFrame, label: str, column: str = "_source") -> DataFrame:
    """All rows of one source give way to the staged ones; rows without a label stay."""
    kept = target.where(~F.col(column).eqNullSafe(F.lit(label)))
    return kept.unionByName(align(staged.withColumn(column, F.lit(label)), target.columns, dict(target.dtypes)))


def replace_window(target: DataFrame, staged: DataFrame, foreign_key: str, parents_in_window: DataFrame) -> DataFrame:
    """Children whose parent is in the window, or has a staged child, give way to the staged ones.
    parents_in_window: one column, named as foreign_key."""
    gone = parents_in_window.select(foreign_key).unionByName(staged.select(foreign_key)).distinct()
    return target.join(gone, foreign_key, "left_anti").select(*target.columns).unionByName(align(staged, target.columns, dict(target.dtypes)))


def mark_deleted(target: DataFrame, live: DataFrame, key: str, now: str, flag: str = "_deleted_in_source", stamp: str = "_timestamp", scope: Column | None = None) -> DataFrame:
    """Revives flagged rows whose key is live and flags others whose key is not; both get a new stamp.
    A NULL flag is neither true nor false and stays. live: one column, k, keys as text."""
    keys = live.select(F.col("k").alias("_live")).distinct()
    joined = target.join(keys, key_text(F.col(key)) == F.col("_live"), "left")
    inside = F.coalesce(scope, F.lit(False)) if scope is not None else F.lit(True)
    revive = inside & (F.col(flag) == True) & F.col("_live").isNotNull()  # noqa: E712
    delete = inside & (F.col(flag) == False) & F.col("_live").isNull()  # noqa: E712
    changed = F.coalesce(revive, F.lit(False)) | F.coalesce(delete, F.lit(False))
    new = {flag: F.when(F.coalesce(revive, F.lit(False)), False).when(F.coalesce(delete, F.lit(False)), True).otherwise(F.col(flag)), stamp: F.when(changed, F.lit(now)).otherwise(F.col(stamp))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in target.columns])


def sync(target: DataFrame, staged: DataFrame, key: str, hash_column: str, now: str, flag: str = "_deleted_in_source", stamp: str = "_timestamp") -> DataFrame:
    """What upsert of new and changed rows, revival and deletion marks make together, in one full outer
    join: each side is shuffled once. staged holds all live rows; keys are unique on both sides."""
    columns = target.columns
    s = align(staged, columns, dict(target.dtypes)).select(key_text(F.col(f"`{key}`")).alias("_sk"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_s"))
    t = target.select(key_text(F.col(f"`{key}`")).alias("_tk"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_t"))
    live, known = F.col("_sk").isNotNull(), F.col("_tk").isNotNull()
    fresh = live & (~known | ~F.col(f"_s.`{hash_column}`").eqNullSafe(F.col(f"_t.`{hash_column}`")))
    old = F.col(f"_t.`{flag}`")
    moved = F.coalesce((live & old) | (~live & ~old), F.lit(False))
    out = []
    for c in columns:
        kept = F.col(f"_t.`{c}`")
        if c == flag:
            kept = F.when(moved, ~old).otherwise(old)
        elif c == stamp:
            kept = F.when(moved, F.lit(now)).otherwise(kept)
        out.append(F.when(fresh, F.col(f"_s.`{c}`")).otherwise(kept).alias(c))
    return s.join(t, F.col("_sk") == F.col("_tk"), "full_outer").select(*out)


def dedup_batches(df: DataFrame, keys: Sequence[str], batch: str) -> DataFrame:
    """Rows whose key came in no earlier batch; repeats inside one batch stay, and so do rows without a key
    only if no other key of their batch came before. A minimum by key combines before the shuffle."""
    first = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.min(batch).alias("_first"))
    kept = df.join(first, list(keys)).where(F.col(batch) == F.col("_first")).select(*df.columns)
    seen = df.join(first, list(keys)).where(F.col(batch) > F.col("_first")).select(batch).distinct()
    return kept.unionByName(df.where(F.col(keys[0]).isNull()).join(seen, batch, "left_anti").select(*df.columns))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    some = key_violations(df, keys).limit(5).collect()
    if some:
        raise DuplicateKeys(f"{', '.join(keys)}: {[tuple(r)[:-1] for r in some]}")


def drop_prefixed(df: DataFrame, prefix: str = "_mage_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])
