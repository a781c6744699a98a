"""The six load methods as pure functions of DataFrames: source and target in, next target and metrics out.

Nothing is written here and, but for the few one-row decisions a method must take, nothing runs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import declared_text_types, decode_bytes_columns, narrow_text, prepare_export
from ..functions.hashing import hash_columns, key_text, row_hash
from ..operators import diff as d
from ..operators import merge
from ..operators.fingerprint import fingerprint, unchanged_slices
from ..operators.predicates import above_watermark, children_of, coalesce_window, cutoff, cutoff_value, either_window
from ..operators.statistics import promote
from ..sources.types import ENCODINGS, NCHAR_TYPES, as_text, cast_target, target_types
from .config import LoadSettings

FLAG, STAMP = "_deleted_in_source", "_timestamp"


@dataclass
class LoadPlan:
    """What a method decided: the target's next state, how it was reached, the rows it stages."""

    target: DataFrame | None
    method: str
    staged: DataFrame | None = None
    status: DataFrame | None = None
    fallback_reason: str | None = None
    fingerprints: DataFrame | None = None
    skipped: tuple[str, ...] = ()
    incremental: bool = False
    phases: dict = field(default_factory=dict)

    def rows_staged(self) -> int:
        """Rows written: from the narrow comparison where there is one."""
        if self.status is not None:
            c = d.counts(self.status).first()
            return c["added"] + c["changed"]
        return self.staged.count() if self.staged is not None else 0

    def status_counts(self) -> dict:
        return d.counts(self.status).first().asDict()

    def release(self) -> None:
        if self.status is not None:
            self.status.unpersist()


@dataclass(frozen=True)
class Declared:
    """Declared source types by column, and the dialect whose they are: what cleaning goes by."""

    dialect: str = "postgres"
    types: Mapping[str, str] = field(default_factory=dict)
    promoted: Mapping[str, str] = field(default_factory=dict)

    def targets(self) -> dict[str, str]:
        return {**target_types(self.dialect, dict(self.types)), **self.promoted}


def read_as_declared(source: DataFrame, d: Declared, convert_nchar: bool = False) -> DataFrame:
    """Text types as text, bytes decoded in the dialect's order where the target holds text, and, if asked, text of two-byte
    types as a single-byte code page holds it."""
    if convert_nchar and d.dialect == "mssql":
        wide = {c for c, t in d.types.items() if t.lower() in NCHAR_TYPES}
        source = source.select(*[narrow_text(F.col(f"`{c}`")).alias(c) if c in wide else F.col(f"`{c}`") for c in source.columns])
    names = declared_text_types({c: t for c, t in d.types.items() if c in source.columns})
    held = [c for c, t in d.targets().items() if t == "BYTEA"]
    binary = [f.name for f in source.schema.fields if f.dataType.typeName() == "binary" and f.name not in d.types]
    out = decode_bytes_columns(source, ENCODINGS[d.dialect], [*held, *binary])
    return as_text(out, names, d.dialect)


def promoted(source: DataFrame, s: LoadSettings, d: Declared) -> Declared:
    """With the promotions that the values ask for, in one pass: INTEGER near its limit, enumerations of 0 and 1."""
    targets = {c: t for c, t in d.targets().items() if c in source.columns}
    numbers = dict(source.select(*[f"`{c}`" for c in targets]).dtypes)
    integers = [c for c, t in targets.items() if t == "INTEGER" and numbers[c] in ("tinyint", "smallint", "int", "bigint")]
    enums = [c for c in targets if d.types[c].lower() == "enum"]
    if not integers and not enums:
        return d
    found = promote(source, integers, enums).collect()  # a row for each of these columns
    return replace(d, promoted={r["column"]: r["pg_type"] for r in found})


def prepare(source: DataFrame, s: LoadSettings, now: str, d: Declared | None = None) -> DataFrame:
    """Source rows as the target holds them: the hash over the values as read, then cleaning by the declared types, flag
    and stamp; empty text becomes NULL only after hashing."""
    if s.where_clause:
        source = source.where(s.where_clause)
    if d is not None and d.types:
        source = read_as_declared(source, d, s.convert_nchar)
    cols = hash_columns(source.columns, s.hash_include or None, s.hash_exclude, s.hash_column)
    h = row_hash(source, [c for c in cols if c != s.batch_column]) if s.hashes else F.lit(None).cast("string")
    if s.hash_column not in source.columns:
        source = source.withColumn(s.hash_column, h)
    if d is not None and d.types:
        targets = {c: t for c, t in d.targets().items() if c in source.columns}
        source = cast_target(prepare_export(source, targets, FLAG, STAMP, now, s.strict_integer_precision), targets)
    texts = {n for n, t in source.dtypes if t == "string"} - {s.hash_column}
    out = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if c in texts else F.col(f"`{c}`") for c in source.columns if c not in (FLAG, STAMP)]
    return source.select(*out, F.lit(now).alias(STAMP), F.lit(False).alias(FLAG))


def full(source: DataFrame, target: DataFrame | None, s: LoadSettings, now: str, reason: str | None = None, d: Declared | None = None) -> LoadPlan:
    """All rows anew. The target's columns keep their order and new ones join at the end. A source
    without rows leaves a target as it is, unless empty_rows_ok. Of a source read in batches (batch_column numbers
    them) a key's rows in later batches than its first are dropped."""
    if target is not None and not s.empty_rows_ok and source.limit(1).count() == 0:
        return LoadPlan(target, "full", fallback_reason=reason or "source_empty")
    if d is not None and d.types:
        d = promoted(read_as_declared(source, d), s, d)
    staged = prepare(source, s, now, d)
    if s.batch_column:
        staged = merge.dedup_batches(staged, [s.key], s.batch_column) if s.key else staged
        staged = staged.drop(s.batch_column)
    if target is not None:
        base = merge.adopt_new_columns(target.limit(0), staged)
        out = base.unionByName(merge.align(staged, base.columns, dict(base.dtypes)))
    else:
        out = staged
    return LoadPlan(out, "full", staged, fallback_reason=reason)


def window(source: DataFrame, s: LoadSettings, at: datetime, dialect: str = "postgres") -> tuple[Column, str]:
    """The window's condition and its first day. A date_column makes the older shape: either column is in the window."""
    day = cutoff(at, s.lookback_hours, s.days_back, s.deep_window)
    since = day.strftime("%Y-%m-%d %H:%M:%S")
    if s.date_column:
        numbers = dict(source.dtypes)[s.date_column] not in ("string", "date", "timestamp", "timestamp_ntz")
        a, b = F.col(f"`{s.date_column}`"), F.col(f"`{s.created_column or s.date_column}`")
        return (either_window(a, b, cutoff_value(day, "firebird")) if numbers else in_window(tuple(c for c in (s.date_column, s.created_column) if c), F.lit(since))), since
    updated = F.col(f"`{s.updated_column or s.created_column}`")
    created = F.col(f"`{s.created_column}`") if s.updated_column and s.created_column else None
    return coalesce_window(updated, created, since, s.zero_date), since


def incremental(source: DataFrame, target: DataFrame | None, s: LoadSettings, now: str, at: datetime, d: Declared | None = None) -> LoadPlan:
    """Rows changed since the cutoff, upserted. New source columns are dropped; managed ones that the target lacks join it."""
    if target is None or target.limit(1).count() == 0:
        return full(source, target, s, now, "target_empty" if target is not None else "target_missing", d)
    changed, since = window(source, s, at)
    staged = prepare(source.where(changed), s, now, d)
    return LoadPlan(merge.upsert(merge.ensure_managed(target, s.hash_column), staged, [s.key]), "incremental", staged, incremental=True, phases={"since": since})


def hash_diff(source: DataFrame, target: DataFrame | None, s: LoadSettings, now: str, d_: Declared | None = None) -> LoadPlan:
    """Row hashes compared: new and changed rows upserted, rows gone from the source flagged, rows back
    unflagged. Falls back to a full load when hashes cannot be compared or hardly any match."""
    reason = d.precheck(target, s.key, s.hash_column, s.ignore_hash)
    if reason:
        return full(source, target, s, now, reason, d_)
    target = merge.ensure_managed(target, s.hash_column)
    staged = prepare(source, s, now, d_)
    now_side = staged.select(key_text(F.col(s.key)).alias("k"), F.col(s.hash_column).alias("h"))
    # narrow: keys and hashes alone; kept for the decision, the counts and whoever asks for changed rows
    status = d.diff(now_side, d.snapshot(target, s.key, hash_column=s.hash_column)).persist(StorageLevel.DISK_ONLY)
    if d.reseed_decision(status, target, s.hash_column).first()["reseed"]:
        status.unpersist()
        return full(source, target, s, now, "reseed", d_)
    moved = staged.join(d.changed_keys(status).select("k"), key_text(F.col(s.key)) == F.col("k"), "left_semi")
    return LoadPlan(merge.sync(target, staged, s.key, s.hash_column, now), "hash", moved, status, incremental=True)


def id_watermark(source: DataFrame, target: DataFrame | None, s: LoadSettings, now: str, d: Declared | None = None) -> LoadPlan:
    """Rows above the target's greatest key. Changes, deletions and late lower keys are not seen."""
    if target is None or target.limit(1).count() == 0:
        return full(source, target, s, now, "target_empty" if target is not None else "target_missing", d)
    staged = prepare(above_watermark(source, target, s.key), s, now, d)
    return LoadPlan(merge.upsert(merge.ensure_managed(target, s.hash_column), staged, [s.key]), "id_watermark", staged, incremental=True)


def in_window(dates: tuple[str, ...], since: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) >= since, F.lit(False)) for c in dates])


def parent_incremental(source: DataFrame, target: DataFrame | None, parents: DataFrame, target_parents: DataFrame | None, s: LoadSettings, now: str, at: datetime, d: Declared | None = None) -> LoadPlan:
    """Children of parents in the window, which replace the target's children of these parents, whether the
    parent is in the window in the target's copy or has a staged child. An empty target is not
    filled beyond the window, which without hours begins on 1 January."""
    since = F.lit(cutoff(at, s.lookback_hours, s.days_back, True).strftime("%Y-%m-%d %H:%M:%S"))
    staged = prepare(children_of(source, parents, s.foreign_key, s.parent_key, in_window(s.parent_dates, since)), s, now, d)
    if target is None:
        return LoadPlan(staged, "parent_incremental", staged, incremental=True)
    target = merge.ensure_managed(target, s.hash_column)
    known = parents if target_parents is None else target_parents
    window = known.where(in_window(s.parent_dates, since)).select(F.col(s.parent_key).alias(s.foreign_key))
    return LoadPlan(merge.replace_window(target, staged, s.foreign_key, window), "parent_incremental", staged, incremental=True)


def slice_plans(sources: Mapping[str, DataFrame], target: DataFrame | None, s: LoadSettings, now: str, before: DataFrame | None = None, d: Declared | None = None) -> tuple[dict[str, DataFrame], DataFrame | None, tuple[str, ...]]:
    """(staged rows by source, fingerprints, sources skipped)."""
    p = full_by_source(sources, target, s, now, before)
    return {n: prepare(df, s, now, d).withColumn("_source", F.lit(n)) for n, df in sources.items() if n not in p.skipped}, p.fingerprints, p.skipped


def full_by_source(sources: Mapping[str, DataFrame], target: DataFrame | None, s: LoadSettings, now: str, before: DataFrame | None = None) -> LoadPlan:
    """Each source's slice anew, by its label; slices whose fingerprint is as before, and which the target
    still holds, are skipped. The new fingerprints are the caller's to keep after a success."""
    prints = None
    skip: set[str] = set()
    if s.fingerprint_mode != "off":
        each = [fingerprint(df, s.key, s.fingerprint_stamp, s.fingerprint_columns if s.fingerprint_mode == "aggregate" else ()).withColumn("_source", F.lit(n)) for n, df in sources.items()]
        prints = reduce(lambda a, b: a.unionByName(b), each)
        if before is not None and target is not None:
            skip = {r["_source"] for r in unchanged_slices(prints, before, target).collect()}  # one row a source
    out = target
    staged = []
    for name, df in sources.items():
        if name in skip:
            continue
        part = prepare(df, s, now).withColumn("_source", F.lit(name))
        staged.append(part)
        out = part if out is None else merge.replace_slice(out, part.drop("_source"), name)
    method = "full_by_source" if staged or not sources else "unchanged"
    return LoadPlan(out, method, reduce(lambda a, b: a.unionByName(b), staged) if staged else None, fingerprints=prints, skipped=tuple(sorted(skip)))
