"""A load's configuration: plain mappings in, checked dataclasses out; all errors at once."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions.clean import is_truthy
from ..operators.partitions import PartitionSpec, parse_spec
from ..sources.types import FEATURES

METHODS = ("full", "full_by_source", "incremental", "hash", "hash_diff", "id_watermark", "parent_incremental")
#: Accepted for old configurations, without effect: Spark reads in parallel by itself.
INERT_KEYS = ("pagination_mode", "keyset_pagination", "conflict_columns", "num_parallel")


class ConfigError(ValueError):
    """Every problem of a configuration, one a line."""


@dataclass(frozen=True)
class LoadSettings:
    method: str = "full"
    key: str | None = None
    hash_column: str = "row_hash"
    updated_column: str | None = None
    created_column: str | None = None
    zero_date: str | None = None
    where_clause: str | None = None
    lookback_hours: float | None = None
    days_back: int | None = None
    deep: bool = False
    only_columns: tuple[str, ...] = ()
    exclude_columns: tuple[str, ...] = ()
    hash_include: tuple[str, ...] = ()
    hash_exclude: tuple[str, ...] = ()
    parent_table: str | None = None
    parent_key: str | None = None
    foreign_key: str | None = None
    parent_dates: tuple[str, ...] = ()
    fingerprint_stamp: str | None = None
    fingerprint_columns: tuple[str, ...] = ()
    fingerprint_mode: str = "off"
    surrogate: tuple[str, str] | None = None
    partition: PartitionSpec | None = None
    empty_rows_ok: bool = False
    ignore_hash: bool = False
    compute_row_hash: bool | None = None  # not said: yes, but not for slices by source
    force_reload: bool = False
    resume_full_load: bool = False
    strict_integer_precision: bool = False
    convert_nchar: bool = False
    date_column: str | None = None  # a window of the older shape, over it or created_column
    reserved_words: tuple[str, ...] = ()
    batch_column: str | None = None
    read_retry_attempts: int = 5
    read_retry_base_delay: float = 5.0

    @property
    def deep_window(self) -> bool:
        """Whether a window without hours begins on 1 January: said so, or named by the keys that mean it."""
        return self.deep or bool(self.date_column or self.parent_table)

    @property
    def hashes(self) -> bool:
        return self.method != "full_by_source" if self.compute_row_hash is None else self.compute_row_hash


@dataclass(frozen=True)
class LoadConfig:
    table: str
    target: str
    dialect: str = "postgres"
    sources: tuple[str, ...] | None = None
    settings: LoadSettings = field(default_factory=LoadSettings)
    types: Mapping[str, str] = field(default_factory=dict)


_FLAGS = ("deep", "empty_rows_ok", "ignore_hash", "compute_row_hash", "force_reload", "resume_full_load", "strict_integer_precision", "convert_nchar")
_LISTS = ("only_columns", "exclude_columns", "hash_include", "hash_exclude", "parent_dates", "fingerprint_columns", "reserved_words")


# Keys of older configurations, by the settings they name.
OLDER_KEYS = {
    "load_method": "method", "primary_column": "key", "primary_key_column": "key", "created_at_column": "created_column", "updated_at_column": "updated_column",
    "hash_include_columns": "hash_include", "hash_exclude_columns": "hash_exclude", "convert_nchar_to_varchar": "convert_nchar", "incremental_date_column": "date_column",
    "incremental_date_column_fallback": "created_column", "incremental_lookback_hours": "lookback_hours", "incremental_parent_table": "parent_table",
    "incremental_parent_key_column": "foreign_key", "incremental_parent_id_column": "parent_key",
}
OLDER_PARENT_DATES = ("incremental_parent_date_column", "incremental_parent_date_column_fallback")
#: Read in older configurations, without effect here: Spark sizes its own batches and partitions.
OLDER_INERT = ("batch_size", "hash_diff_buffer_size", "hash_download_batch_size", "skip_size_estimate", "multi_source", "incremental_parent_output_name")


def from_older(raw: Mapping[str, Any]) -> dict[str, Any]:
    """A configuration of the sections TABLE, LOAD_SETTINGS, DATABASES and FINGERPRINT, with their top-level fallbacks, in
    the form that parse() reads."""
    table, load = dict(raw.get("TABLE") or {}), dict(raw.get("LOAD_SETTINGS") or {})
    name = table.get("source_name") or raw.get("TABLE_NAME") or ""
    settings: dict[str, Any] = {OLDER_KEYS.get(k, k): v for k, v in load.items() if v is not None and k not in (*OLDER_INERT, *OLDER_PARENT_DATES, "surrogate_key_enabled", "surrogate_key_definition")}
    dates = tuple(load[k] for k in OLDER_PARENT_DATES if load.get(k))
    if dates:
        settings["parent_dates"] = dates
    if settings.get("parent_table"):
        settings.setdefault("parent_key", "id")
    if is_truthy(load.get("surrogate_key_enabled")) and load.get("surrogate_key_definition"):
        settings["surrogate"] = (settings.get("key") or "surrogate_key", load["surrogate_key_definition"])
    if table.get("selected_columns") and is_truthy(table.get("only_selected_columns")):
        settings["only_columns"] = table["selected_columns"]
    if table.get("excluded_columns"):
        settings["exclude_columns"] = table["excluded_columns"]
    if table.get("where_clause"):
        settings["where_clause"] = table["where_clause"]
    settings["empty_rows_ok"] = table.get("empty_rows_ok", raw.get("EMPTY_ROWS_OK", False))
    prints = dict(raw.get("FINGERPRINT") or {})
    settings |= {f"fingerprint_{k}": v for k, v in prints.items() if k in ("mode", "stamp", "columns")}
    target = table.get("output_table") or table.get("output_name") or raw.get("OUTPUT_TABLE") or name
    out = {"table": name, "target": target, "dialect": raw.get("DIALECT", "postgres"), "settings": settings, "types": raw.get("types", {})}
    if raw.get("DATABASES") is not None:
        out["sources"] = [d["name"] if isinstance(d, Mapping) else d for d in raw["DATABASES"]]
    return out


def parse(raw: Mapping[str, Any]) -> LoadConfig:
    """Reads table, target, dialect, sources, types and settings, or the sections of an older configuration; unknown
    settings are an error, inert ones are not."""
    if "TABLE" in raw or "LOAD_SETTINGS" in raw:
        raw = from_older(raw)
    given = dict(raw.get("settings", {}))
    errors, kept = [], {}
    known = set(LoadSettings.__dataclass_fields__) | set(INERT_KEYS) | {"partition_by", "partition_by_source"}
    for name, value in given.items():
        if name not in known:
            errors.append(f"unknown setting {name!r}")
        elif name in _FLAGS:
            kept[name] = None if value is None else is_truthy(value)
        elif name in ("lookback_hours", "days_back", "read_retry_attempts", "read_retry_base_delay"):
            try:
                kept[name] = None if value in (None, "") else float(value) if name in ("lookback_hours", "read_retry_base_delay") else int(value)
            except (TypeError, ValueError):
                errors.append(f"{name} is not a number")
        elif name in _LISTS:
            kept[name] = tuple(value) if not isinstance(value, str) else tuple(x.strip() for x in value.split(",") if x.strip())
        elif name in LoadSettings.__dataclass_fields__:
            kept[name] = value
    try:
        kept["partition"] = parse_spec(given.get("partition_by"), is_truthy(given.get("partition_by_source")))
    except ValueError as e:
        errors.append(str(e))
    sources = raw.get("sources")
    config = LoadConfig(str(raw.get("table") or ""), str(raw.get("target") or raw.get("table") or ""), str(raw.get("dialect", "postgres")), None if sources is None else tuple(sources), LoadSettings(**kept), dict(raw.get("types", {})))
    errors += problems(config)
    if errors:
        raise ConfigError("\n".join(errors))
    return config


def problems(c: LoadConfig) -> list[str]:
    s, out = c.settings, []
    if not c.table:
        out.append("table is missing")
    if c.dialect not in FEATURES:
        out.append(f"dialect {c.dialect!r} is not one of {', '.join(FEATURES)}")
    if s.method not in METHODS:
        out.append(f"method {s.method!r} is not one of {', '.join(METHODS)}")
    if s.method in ("incremental", "hash", "hash_diff", "id_watermark", "parent_incremental") and not s.key:
        out.append(f"method {s.method} needs a key")
    if s.method == "incremental" and not (s.updated_column or s.created_column or s.date_column or s.parent_table):
        out.append("method incremental needs updated_column, created_column or date_column")
    if s.method in METHODS and c.dialect in FEATURES:
        needed = {"hash": "hash_diff", "id_watermark": "keyset", "full_by_source": "partition_by_source", "parent_incremental": "parent_incremental"}.get(resolve_method(s))
        if needed and needed not in FEATURES[c.dialect]:
            out.append(f"dialect {c.dialect!r} does not support {needed}; it supports {', '.join(sorted(FEATURES[c.dialect]))}")
    if c.sources and len(c.sources) > 1 and resolve_method(s) != "full_by_source":
        out.append(f"several sources need method full_by_source: by method {s.method} each would take the others' rows for its own")
    if (s.method == "parent_incremental" or s.method == "incremental" and s.parent_table) and not (s.parent_table and s.parent_key and s.foreign_key and s.parent_dates):
        out.append("a parent window needs parent_table, parent_key, foreign_key and parent_dates")
    if s.fingerprint_mode not in ("off", "stamp", "aggregate"):
        out.append("fingerprint_mode is off, stamp or aggregate")
    for name in ("lookback_hours", "days_back"):
        if getattr(s, name) is not None and float(getattr(s, name)) < 0:
            out.append(f"{name} is negative")
    return out


def required_columns(s: LoadSettings, columns: list[str]) -> list[str]:
    """Columns a method cannot do without, as the source names them; every keyed method keeps its key."""
    want = [s.key, s.hash_column]
    if s.method == "incremental":
        want += [s.updated_column, s.created_column, s.date_column]
    if s.method == "parent_incremental":
        want.append(s.foreign_key)
    if s.partition:
        want.append(s.partition.column)
    want.append(s.batch_column)
    lower = {c.lower(): c for c in columns}
    return list(dict.fromkeys(lower[w.lower()] for w in want if w and w.lower() in lower))


def resolve_method(s: LoadSettings) -> str:
    """The load method that runs: a full load that may resume reads above the watermark; an incremental one with a
    parent follows the parent; a forced reload is full, but for slices by source."""
    method = "hash" if s.method == "hash_diff" else s.method
    if s.force_reload and method != "full_by_source":
        return "full"
    if method == "full" and s.resume_full_load:
        return "id_watermark"
    return "parent_incremental" if method == "incremental" and s.parent_table else method


_SECRETS = (
    (re.compile(r"(password|passwd|pwd)\s*=\s*('[^']*'|\S+)", re.I), r"\1=***"),
    (re.compile(r"(\w[\w+.-]*://[^:/@\s]+):[^@\s]+@"), r"\1:***@"),
    (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S), "***"),
)


def redact(text: str, extra: tuple[str, ...] = ()) -> str:
    """Masks passwords of URLs and connection strings, private keys, and the literals in extra."""
    for pattern, mask in _SECRETS:
        text = pattern.sub(mask, text)
    for secret in sorted((x for x in extra if x), key=len, reverse=True):
        text = text.replace(secret, "***")
    return text


def retry_delays(attempts: int = 3, first: float = 2.0, most: float = 30.0, jitter: float = 0.1, draw: float = 0.5) -> list[float]:
    """Pauses between attempts, doubling up to most; draw in 0..1 places each within its jitter."""
    return [min(most, first * 2**k) * (1 + jitter * (2 * draw - 1)) for k in range(attempts - 1)]


TRANSIENT = ("timeout", "timed out", "connection reset", "connection refused", "broken pipe", "lost connection", "server has gone away", "deadlock", "too many connections")


def is_transient(message: str) -> bool:
    return any(x in message.lower() for x in TRANSIENT)


def retried(work: Callable[[], Any], attempts: int = 5, first: float = 5.0, most: float = 60.0, pause: Callable[[float], None] = time.sleep) -> Any:
    """work's result; a transient failure is tried again after a pause, any other or the last one is raised."""
    for delay in [*retry_delays(attempts, first, most), None]:
        try:
            return work()
        except Exception as e:
            if delay is None or not is_transient(str(e)):
                raise
            pause(delay)
    return None


def resolve_target(*given: tuple[str, str | None]) -> str:
    """The address of the target: the first of (where it would stand, what stands there) that holds one; none is an error that
    names all places."""
    for _, value in given:
        if value:
            return value
    raise ConfigError(f"no target: none of {', '.join(place for place, _ in given)} is set")
