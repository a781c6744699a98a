"""The five-level comparator: do two tables match, and if not, at which level do they first differ?

1 row counts, 2 column names and order, 3 types, 4 column checksums, 5 rows by key. All levels run
even after one has failed; a level that cannot run says why.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import content_hash
from .checksum import checksums, family
from .diff import differs

MAX_COLUMNS_SHOWN = 25


@dataclass(frozen=True)
class Difference:
    level: int
    kind: str
    column: str = ""
    left: str = ""
    right: str = ""


@dataclass
class LevelResult:
    level: int
    passed: bool
    skipped: str = ""
    differences: list[Difference] = field(default_factory=list)
    accepted: list[Difference] = field(default_factory=list)


@dataclass
class TableReport:
    name: str
    levels: list[LevelResult] = field(default_factory=list)
    error: str = ""
    samples: list[dict] = field(default_factory=list)

    @property
    def first_failed(self) -> int | None:
        return next((x.level for x in self.levels if not x.passed), None)

    @property
    def verdict(self) -> str:
        """ERROR, DIFF, MATCH* (after accepted deviations) or MATCH."""
        if self.error:
            return "ERROR"
        if self.first_failed:
            return "DIFF"
        return "MATCH*" if any(x.accepted for x in self.levels) else "MATCH"

    def to_json(self) -> str:
        d = [{"level": x.level, "passed": x.passed, "skipped": x.skipped, "differences": [vars(y) for y in x.differences], "accepted": [vars(y) for y in x.accepted]} for x in self.levels]
        return json.dumps({"table": self.name, "verdict": self.verdict, "first_failed_level": self.first_failed, "error": self.error, "levels": d, "samples": self.samples}, default=str)

    def to_text(self) -> str:
        lines = [f"{self.name}: {self.verdict}" + (f" (level {self.first_failed})" if self.first_failed else "") + (f" {self.error}" if self.error else "")]
        for x in self.levels:
            lines.append(f"  level {x.level}: {'skipped, ' + x.skipped if x.skipped else 'ok' if x.passed else 'differs'}")
            lines += [f"    {y.kind} {y.column} {y.left} | {y.right}".rstrip() for y in x.differences[:MAX_COLUMNS_SHOWN]]
            if len(x.differences) > MAX_COLUMNS_SHOWN:
                lines.append(f"    and {len(x.differences) - MAX_COLUMNS_SHOWN} more")
        return "\n".join(lines)


def column_differences(left: Sequence[str], right: Sequence[str]) -> list[Difference]:
    out = [Difference(2, "missing", c) for c in left if c not in set(right)]
    out += [Difference(2, "surplus", c) for c in right if c not in set(left)]
    shared_l, shared_r = [c for c in left if c in set(right)], [c for c in right if c in set(left)]
    if shared_l != shared_r:
        out.append(Difference(2, "reordered", "", ",".join(shared_l), ",".join(shared_r)))
    return out


#: The fields of a type signature, which a column's metadata may declare where Spark's types do not hold them.
SIGNATURE = ("type", "udt_name", "nullable", "char_max_length", "numeric_precision", "numeric_scale", "datetime_precision", "collation")


def signature(f: T.StructField) -> dict[str, str]:
    """Type, declared name, nullability, length, precision, scale, precision of times, collation."""
    t, m = f.dataType, f.metadata or {}
    numbers = {T.ByteType: (8, 0), T.ShortType: (16, 0), T.IntegerType: (32, 0), T.LongType: (64, 0), T.FloatType: (24, None), T.DoubleType: (53, None)}
    precision, scale = (t.precision, t.scale) if isinstance(t, T.DecimalType) else numbers.get(type(t), (None, None))
    length = re.match(r"(?:var)?char\((\d+)\)", str(m.get("__CHAR_VARCHAR_TYPE_STRING", "")))
    found = {
        "type": t.typeName(), "udt_name": m.get("udt_name", t.simpleString()), "nullable": f.nullable, "char_max_length": m.get("char_max_length", length and length.group(1)), "numeric_precision": precision, "numeric_scale": scale,
        "datetime_precision": m.get("datetime_precision", 6 if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else None), "collation": m.get("collation", getattr(t, "collation", None)),
    }
    return {k: "" if found[k] is None else str(found[k]) for k in SIGNATURE}


def type_differences(left: DataFrame, right: DataFrame) -> list[Difference]:
    """The first field of the signature in which a common column differs, then other metadata."""
    r, out = {f.name: f for f in right.schema.fields}, []
    for f in left.schema.fields:
        if (g := r.get(f.name)) is None:
            continue
        a, b = signature(f), signature(g)
        if f.dataType != g.dataType:
            out.append(Difference(3, "type", f.name, f.dataType.simpleString(), g.dataType.simpleString()))
        elif differing := [k for k in SIGNATURE if a[k] != b[k]]:
            out.append(Difference(3, differing[0], f.name, a[differing[0]], b[differing[0]]))
        elif f.metadata != g.metadata:
            out.append(Difference(3, "metadata", f.name, str(f.metadata), str(g.metadata)))
    return out


def checksum_differences(left: DataFrame, right: DataFrame, columns: Sequence[str], as_text: Sequence[str] = ()) -> DataFrame:
    """(column, measure, left, right) where the tables' checksums differ; one pass over each table."""
    a, b = (checksums(x, columns, as_text).withColumnRenamed("value", n) for x, n in ((left, "left"), (right, "right")))
    return a.join(b, ["column", "measure"], "full_outer").where(differs(F.col("left"), F.col("right")))


def row_status(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], stored_hash: str | None = None) -> DataFrame:
    """(keys, in_left, in_right, stored_differs, content_differs) of every key, by a full outer join on
    null-safe keys and a hash of the contents."""
    def side(df, p):
        cols = [F.col(f"`{k}`").alias(f"{p}{i}") for i, k in enumerate(keys)]
        stored = F.col(f"`{stored_hash}`").cast("string") if stored_hash else F.lit(None).cast("string")
        return df.select(*cols, stored.alias(f"{p}stored"), content_hash(df, columns).alias(f"{p}content"))

    on = None
    for i in range(len(keys)):
        c = F.col(f"l{i}").eqNullSafe(F.col(f"r{i}"))
        on = c if on is None else on & c
    j = side(left, "l").join(side(right, "r"), on, "full_outer")
    both = F.col("lcontent").isNotNull() & F.col("rcontent").isNotNull()
    named = [F.when(F.col("lcontent").isNotNull(), F.col(f"l{i}")).otherwise(F.col(f"r{i}")).alias(k) for i, k in enumerate(keys)]
    return j.select(*named, F.col("lcontent").isNotNull().alias("in_left"), F.col("rcontent").isNotNull().alias("in_right"), (both & differs(F.col("lstored"), F.col("rstored"))).alias("stored_differs"), (both & differs(F.col("lcontent"), F.col("rcontent"))).alias("content_differs"))


def row_counts(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("only_left"),
        F.count_if(F.col("in_right") & ~F.col("in_left")).alias("only_right"),
        F.count_if(F.col("stored_differs")).alias("stored_differs"),
        F.count_if(F.col("content_differs")).alias("content_differs"),
        F.count_if(F.col("content_differs") & ~F.col("stored_differs")).alias("hidden_differs"),
    )


def row_samples(status: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The first n differing keys by kind and key: a top-n, not a sort of all."""
    kind = F.when(~F.col("in_right"), "only_left").when(~F.col("in_left"), "only_right").when(F.col("content_differs"), "content").when(F.col("stored_differs"), "stored")
    return status.select(kind.alias("kind"), *keys).where(F.col("kind").isNotNull()).orderBy("kind", *keys).limit(n)


def narrowest_key(candidates: Sequence[tuple[Sequence[str], bool]]) -> list[str] | None:
    """The primary key if declared, else the unique key of fewest columns. candidates: (columns, is primary)."""
    return list(min(candidates, key=lambda c: (not c[1], len(c[0])))[0]) if candidates else None


Rule = Callable[[Difference], bool]

_MANAGED = ("row_hash", "_timestamp", "_deleted_in_source", "_source")


def _managed_order(d: Difference) -> bool:
    """Only managed columns changed places: the others stand as they did."""
    left, right = ([c for c in x.split(",") if c not in _MANAGED] for x in (d.left, d.right))
    places = all((a in _MANAGED) == (b in _MANAGED) for a, b in zip(d.left.split(","), d.right.split(",")))
    return d.kind == "reordered" and left == right and places


#: Recorded deviations, by name; each turns MATCH into MATCH*. They are bound to the columns that a load adds, and to
#: reserved names, and hold in one direction.
DEVIATIONS: dict[str, Rule] = {
    "deleted_flag_not_null": lambda d: d.kind == "nullable" and d.column == "_deleted_in_source" and (d.left, d.right) == ("True", "False"),
    "reserved_column_typed": lambda d: d.kind == "type" and d.column.startswith("_") and d.column not in _MANAGED and d.left == "string" != d.right,
    "managed_column_added": lambda d: d.kind == "surplus" and d.column in ("row_hash", "_timestamp", "_deleted_in_source"),
    "managed_columns_reordered": _managed_order,
}


def compare(name: str, left: DataFrame | None, right: DataFrame | None, keys: Sequence[str] | None = None, volatile: Iterable[str] = ("_timestamp",), accept: Sequence[str] = (), stored_hash: str | None = None, samples: int = 20) -> TableReport:
    """Runs all levels; any exception makes the report an error, never a difference."""
    report = TableReport(name)
    try:
        if left is None or right is None:
            which = "left" if left is None else "right"
            report.levels = [LevelResult(1, False, differences=[Difference(1, f"{which} table is missing")])]
            report.levels += [LevelResult(k, False, "a table is missing") for k in range(2, 6)]
            return report

        def level(k: int, found: list[Difference]) -> None:
            taken = [d for d in found if any(DEVIATIONS[r](d) for r in accept)]
            rest = [d for d in found if d not in taken]
            report.levels.append(LevelResult(k, not rest, differences=rest, accepted=taken))

        lt, rt = dict(left.dtypes), dict(right.dtypes)
        common = [c for c in left.columns if c in rt and c not in set(volatile)]
        same = [c for c in common if lt[c] == rt[c]]
        # one aggregate over each table gives the counts and all checksums: a row for each measure
        a, b = ({(r["column"], r["measure"]): r["value"] for r in checksums(x.select(*[f"`{c}`" for c in same]), same).collect()} for x in (left, right))
        rows = ("", "row_count")
        level(1, [] if a[rows] == b[rows] else [Difference(1, "rows", "", a[rows], b[rows])])
        level(2, column_differences(left.columns, right.columns))
        level(3, type_differences(left, right))
        level(4, [Difference(4, m, c, str(a[c, m]), str(b[c, m])) for c, m in sorted(a) if (c, m) != rows and a[c, m] != b[c, m]])
        if not keys or any(k not in common for k in keys):
            report.levels.append(LevelResult(5, True, "no key"))
            return report
        status = row_status(left, right, keys, same, stored_hash if stored_hash in common else None)
        # the join runs once: rows that differ are kept for the counts and the samples
        status = status.where(~F.col("in_left") | ~F.col("in_right") | F.col("stored_differs") | F.col("content_differs")).persist(StorageLevel.DISK_ONLY)
        try:
            n = row_counts(status).first().asDict()
            level(5, [Difference(5, k, "", str(v), "") for k, v in n.items() if v])
            if not report.levels[-1].passed:
                report.samples = [r.asDict() for r in row_samples(status, keys, samples).collect()]
        finally:
            status.unpersist()
    except Exception as e:  # a report, not a crash: the caller compares many tables
        report.error = f"{type(e).__name__}: {str(e)[:500]}"
    return report


def roll_up(reports: Sequence[TableReport]) -> dict[str, int]:
    """Counts by verdict; exit_code 0: all match, 1: some differ, 2: some failed."""
    out = {v: sum(r.verdict == v for r in reports) for v in ("MATCH", "MATCH*", "DIFF", "ERROR")}
    return out | {"total": len(reports), "exit_code": 2 if out["ERROR"] else 1 if out["DIFF"] else 0}


__all__ = ["DEVIATIONS", "Difference", "LevelResult", "TableReport", "checksum_differences", "column_differences", "compare", "family", "narrowest_key", "roll_up", "row_counts", "row_samples", "row_status", "type_differences"]
