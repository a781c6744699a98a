"""Column checksums that two tables can be compared by: any number of columns in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import finite


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return "numeric"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    return "text" if isinstance(dtype, T.StringType) else "json"


def hash_sums(text: Column) -> tuple[Column, Column]:
    """Sums of the first and second eight hex digits of each MD5, as unsigned numbers: order does not matter."""
    h = F.md5(F.encode(text, "utf-8"))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return part(1), part(9)


_LIMB = 10**18


def exact_sum(c: Column, dtype: T.DataType) -> Column:
    """The sum as text, exact for any decimal and any number of rows: whole numbers that 38 digits cannot overflow are summed as
    they are, others in three parts (multiples of 10**18, units, fraction) that stand side by side."""
    digits, scale = (dtype.precision, dtype.scale) if isinstance(dtype, T.DecimalType) else (19, 0)
    if digits + 12 <= 38:
        return F.sum(c.cast(f"decimal(38,{scale})")).cast("string")
    # remainders keep their digits, where a difference of wide decimals would be rounded
    wide, limb = "decimal(38,0)", F.lit(_LIMB)
    x = c.cast(f"decimal(38,{scale})")
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast(wide)
    low = whole % limb
    parts = [((whole - low) / limb).cast(wide), low.cast(wide)]
    if scale:
        parts.append((x % F.lit(1)).cast(f"decimal(38,{scale})"))
    return F.concat_ws("+", *[F.sum(p).cast(p_type).cast("string") for p, p_type in zip(parts, (wide, wide, f"decimal(38,{scale})"))])


def measures(name: str, dtype: T.DataType) -> dict[str, Column]:
    """The aggregates of one column by its family; all as text, so that tables of checksums compare. Numbers are
    neither rounded nor do they overflow: decimals are summed at their own scale, and the sums for doubles are over hashes
    of their shortest texts."""
    c = F.col(f"`{name}`")
    nulls = F.count_if(c.isNull()).cast("string")
    kind = family(dtype)
    if kind == "numeric":
        return {"nulls": nulls, "sum": exact_sum(c, dtype), "min": F.min(c).cast("string"), "max": F.max(c).cast("string")}
    if kind == "float":
        x = F.when(finite(c), F.when(c == 0, F.abs(c)).otherwise(c))  # one zero
        h1, h2 = hash_sums(x.cast("string"))
        return {"nulls": nulls, "min": F.min(x).cast("string"), "max": F.max(x).cast("string"), "h1": h1, "h2": h2, "nonfinite": F.count_if(c.isNotNull() & ~finite(c)).cast("string")}
    if kind == "boolean":
        return {"nulls": nulls, "true": F.count_if(c).cast("string"), "false": F.count_if(~c).cast("string")}
    if kind == "temporal":
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if not isinstance(dtype, T.DateType) else F.date_format(c, "yyyy-MM-dd")
        h1, h2 = hash_sums(text)
        return {"nulls": nulls, "min": F.min(text), "max": F.max(text), "h1": h1, "h2": h2}
    if kind == "binary":
        h1, h2 = hash_sums(F.lower(F.hex(c)))
        return {"nulls": nulls, "bytes": F.sum(F.octet_length(c)).cast("string"), "h1": h1, "h2": h2}
    text = c if kind == "text" else F.to_json(c)
    h1, h2 = hash_sums(text)
    out = {"nulls": nulls, "min": F.min(text), "max": F.max(text), "h1": h1, "h2": h2}
    return out | {"chars": F.sum(F.length(c)).cast("string")} if kind == "text" else out


def checksums(df: DataFrame, columns: Sequence[str] | None = None, as_text: Sequence[str] = ()) -> DataFrame:
    """(column, measure, value) of every column and row_count, from one aggregate over the table."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols, aggs, rows = columns or df.columns, [F.count("*").cast("string").alias("m")], []
    rows.append(F.struct(F.lit("").alias("column"), F.lit("row_count").alias("measure"), F.col("m").alias("value")))
    frame = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in as_text else F.col(f"`{c}`") for c in cols])
    for i, c in enumerate(cols):
        for k, (name, x) in enumerate(measures(c, T.StringType() if c in as_text else types[c]).items()):
            aggs.append(x.alias(f"m{i}_{k}"))
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(name).alias("measure"), F.col(f"m{i}_{k}").alias("value")))
    return frame.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
