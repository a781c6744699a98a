"""A run: configuration in, target published, one status row for each source out."""

from __future__ import annotations

import logging
import time
import warnings
from collections.abc import Mapping
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import target_column_names
from ..operators.merge import assert_unique, replace_slice
from ..operators.partitions import effective_spec, route, unique_key
from ..sources.store import TargetStore
from ..sources.tables import project, select_columns
from . import strategies as st
from .config import ConfigError, LoadConfig, LoadSettings, parse, redact, required_columns, resolve_method, retried

STATUS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("load_method", T.StringType()),
        T.StructField("is_incremental", T.BooleanType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("rows_written", T.LongType()),
        T.StructField("data_present", T.BooleanType()),
        T.StructField("fallback_reason", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


log = logging.getLogger("tideline")


def progress(done: int, total: int, seconds: float) -> str:
    """A line that says how far a run is, and when it will end at this rate."""
    share = f"{100 * done / total:.0f} %" if total else "100 %"
    left = f", {seconds * (total - done) / done:.0f} s left" if 0 < done < total else ""
    return f"{done} of {total} ({share}){left}"


class SourceError(RuntimeError):
    """Some sources failed; the others were loaded. `status` has a row for each."""

    def __init__(self, message: str, status: DataFrame):
        super().__init__(message)
        self.status = status


def _row(c: LoadConfig, source: str, method: str, *, incremental=False, read=0, written=0, present=False, reason=None, status="ok", error=None) -> tuple:
    return c.table, source, method, incremental, read, written, present, reason, status, error


def run(spark: SparkSession, raw: Mapping, sources: Mapping[str, DataFrame], store: TargetStore, now: datetime, parents: DataFrame | None = None, target_parents: DataFrame | None = None, fingerprints: TargetStore | None = None) -> DataFrame:
    """Loads a table. sources: a DataFrame for each source's label; with `sources: []` in the
    configuration nothing is selected and the run is a success. The target is published only when its next
    state has been written whole and its key is unique; until then readers see the old one."""
    c = parse(raw)
    s, stamp = c.settings, now.strftime("%Y-%m-%dT%H:%M:%SZ")
    chosen = {n: sources[n] for n in (c.sources if c.sources is not None else sources) if n in sources}
    if not chosen:
        return spark.createDataFrame([_row(c, "", "nothing_selected")], STATUS)
    method = resolve_method(s)
    if len(chosen) > 1 and method != "full_by_source":
        raise ConfigError(f"{c.table}: several sources need method full_by_source, not {method}")
    rows, failed, began = [], [], time.monotonic()

    def narrowed(df: DataFrame) -> DataFrame:
        """The selected rows and columns, under the target's names."""
        cols = select_columns(df.columns, list(s.only_columns) or None, list(s.exclude_columns), required_columns(s, df.columns))
        out = project(df, cols, where=s.where_clause, surrogate=s.surrogate)
        return out.toDF(*names_of(out.columns).values())

    def names_of(columns) -> dict[str, str]:
        return target_column_names(columns, [w.upper() for w in s.reserved_words], s.hash_column)[0]

    def plan(df: DataFrame, target: DataFrame | None) -> st.LoadPlan:
        t, d = named(s, df.columns, names_of), st.Declared(c.dialect, named_types(c.types, df.columns, names_of))
        df = narrowed(df)
        if method == "incremental":
            return st.incremental(df, target, t, stamp, now, d)
        if method == "hash":
            return st.hash_diff(df, target, t, stamp, d)
        if method == "id_watermark":
            return st.id_watermark(df, target, t, stamp, d)
        if method == "parent_incremental":
            return st.parent_incremental(df, target, parents, target_parents, t, stamp, now, d)
        return st.full(df, target, t, stamp, d=d)

    def current() -> DataFrame | None:
        # the partition follows from the row, so that a changed row moves
        df = store.read()
        return df.drop("_partition") if df is not None else df

    def write(out: DataFrame, keys: list[str]) -> str:
        before = store.read()
        exists, held = before is not None, partition_of(before)
        spec, warning = effective_spec(named(s, out.columns, names_of).partition, exists, held)
        if warning:
            warnings.warn(f"{c.table}: {warning}", stacklevel=2)
        version = store.stage(route(out, spec) if spec else out, ["_partition"] if spec else None)
        if keys:
            assert_unique(store.read_version(version), unique_key(keys, spec))
        return version

    def partition_of(before: DataFrame | None) -> str | None:
        return s.partition.column if s.partition and before is not None and "_partition" in before.columns else None

    def tell(name: str, r: tuple) -> None:
        log.info("%s %s: %s, %s rows; %s", c.table, name, r[2], r[5], progress(len(rows), len(chosen), time.monotonic() - began))

    def failure(name: str, e: Exception) -> None:
        failed.append(name)
        rows.append(_row(c, name, "error", status="error", error=redact(f"{type(e).__name__}: {str(e)[:400]}")))

    if method == "full_by_source":
        _slices(spark, c, {n: df for n, df in chosen.items()}, narrowed, names_of, current(), store, fingerprints, stamp, write, rows, failure)
    else:
        for name, df in chosen.items():
            try:
                p = retried(lambda df=df: plan(df, current()), s.read_retry_attempts, s.read_retry_base_delay)
                if p.staged is None:
                    rows.append(_row(c, name, p.method, reason=p.fallback_reason))
                    continue
                try:
                    key = named(s, df.columns, names_of).key
                    version = retried(lambda p=p, key=key: write(p.target, [key] if key else []), s.read_retry_attempts, s.read_retry_base_delay)
                    read, written = counted(p, store.read_version(version), stamp)
                finally:
                    p.release()
                store.publish(version)
                rows.append(_row(c, name, p.method, incremental=p.incremental, read=read, written=written, present=written > 0, reason=p.fallback_reason))
                tell(name, rows[-1])
            except Exception as e:  # one source's failure is that source's row
                failure(name, e)
    status = spark.createDataFrame(rows, STATUS)
    if failed:
        raise SourceError(f"{c.table}: {', '.join(failed)} failed", status)
    return status


def named(s: LoadSettings, columns, names_of) -> LoadSettings:
    """The settings under the target's names; the condition on the source has been applied."""
    names = {k.lower(): v for k, v in names_of(columns).items()}
    one = lambda x: names.get(x.lower(), x) if x else x
    many = lambda xs: tuple(one(x) for x in xs)
    return replace(
        s, where_clause=None, key=one(s.key), updated_column=one(s.updated_column), created_column=one(s.created_column), date_column=one(s.date_column), foreign_key=one(s.foreign_key),
        batch_column=one(s.batch_column), hash_include=many(s.hash_include), hash_exclude=many(s.hash_exclude), fingerprint_stamp=one(s.fingerprint_stamp), fingerprint_columns=many(s.fingerprint_columns),
        partition=replace(s.partition, column=one(s.partition.column)) if s.partition else None,
    )


def named_types(types: Mapping[str, str], columns, names_of) -> dict[str, str]:
    declared, names = {k.lower(): t for k, t in types.items()}, names_of(columns)
    return {names[x]: declared[x.lower()] for x in columns if x.lower() in declared}


def counted(p: st.LoadPlan, version: DataFrame, stamp: str) -> tuple[int, int]:
    """Rows read and written, of what was written: the source is not read again, so that both are of one state."""
    if p.status is not None:
        n = p.status_counts()
        return n["source_rows"], n["added"] + n["changed"]
    n = version.where(F.col(st.STAMP) == stamp).count() if p.incremental else version.count()
    return n, n


def _slices(spark, c, chosen, narrowed, names_of, target, store, fingerprints, stamp, write, rows, failure) -> None:
    """Each source's slice is staged by itself, so that one may fail alone; then the target is written once,
    with all slices that succeeded, and published."""
    ready, prints = {}, []
    for name, df in chosen.items():
        try:
            s = named(c.settings, df.columns, names_of)
            d = st.Declared(c.dialect, named_types(c.types, df.columns, names_of))
            parts, new, skipped = st.slice_plans({name: narrowed(df)}, target, s, stamp, fingerprints.read() if fingerprints else None, d)
            if skipped:
                rows.append(_row(c, name, "unchanged"))
                continue
            version = store.stage(parts[name])
            part = store.read_version(version)
            if s.key:
                assert_unique(part, [s.key])
            ready[name] = (version, part)
            if new is not None:
                prints.append(new)
        except Exception as e:
            failure(name, e)
    if not ready:
        return
    try:
        out = target
        for name, (_, part) in ready.items():
            out = part if out is None else replace_slice(out, part.drop("_source"), name)
        version = write(out, [s.key, "_source"] if s.key else [])
        counts = {n: part.count() for n, (_, part) in ready.items()}
        store.publish(version)
    except Exception as e:
        for name in ready:
            failure(name, e)
        return
    if prints and fingerprints is not None:
        new = reduce(lambda a, b: a.unionByName(b), prints)
        old = fingerprints.read()
        fingerprints.write(new if old is None else old.where(~old["_source"].isin(*ready)).unionByName(new))
    for name, (version, _) in ready.items():
        store.drop(f"{store.PREFIX}{version}")
        rows.append(_row(c, name, "full_by_source", read=counts[name], written=counts[name], present=counts[name] > 0))
