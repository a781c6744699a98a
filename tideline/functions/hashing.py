"""Row hashes. One expression serves the full load and the comparison with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "||"


def hash_columns(columns: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] = (), hash_column: str = "row_hash") -> list[str]:
    """Columns that are hashed, in the source's order."""
    wanted = set(include) if include else set(columns)
    return [c for c in columns if c in wanted and c != hash_column and c not in set(exclude)]


def _joined(texts: Sequence[Column]) -> Column:
    # concat_ws drops NULL, so each part is made not NULL first
    return F.concat_ws(SEPARATOR, *[F.coalesce(t, F.lit("")) for t in texts]) if texts else F.lit("")


def value_texts(df: DataFrame, columns: Sequence[str], promote: bool = False) -> list[Column]:
    """Each value as hashed text; NaN is missing. promote: where every column is a number and one is
    a float, whole numbers read as floats (`1.0`)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = all(isinstance(types[c], T.NumericType) and not isinstance(types[c], T.DecimalType) for c in columns)
    floats = [c for c in columns if isinstance(types[c], (T.FloatType, T.DoubleType))]
    out = []
    for c in columns:
        x = F.col(f"`{c}`")
        if promote and numeric and floats and c not in floats:
            x = x.cast("double")
        elif c in floats:
            x = F.nanvl(x, F.lit(None))
        elif isinstance(types[c], T.BinaryType):
            x = F.lower(F.hex(x))
        out.append(x.cast("string"))
    return out


def row_hash(df: DataFrame, columns: Sequence[str], promote: bool = False) -> Column:
    """SHA-256, lower-case hex, of the values joined by a double pipe; missing values are empty."""
    return F.sha2(_joined(value_texts(df, columns, promote)), 256)


def row_hash_utf16(df: DataFrame, columns: Sequence[str]) -> Column:
    """The upper-case SHA-256 over UTF-16LE, as the third dialect's server makes it."""
    return F.upper(F.sha2(F.encode(_joined(value_texts(df, columns)), "UTF-16LE"), 256))


def key_text(c: Column) -> Column:
    """A key as text; missing is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def add_hash_and_timestamp(df: DataFrame, columns: Sequence[str], now: str, hash_column: str = "row_hash", force: bool = False) -> DataFrame:
    if force or hash_column not in df.columns:
        df = df.withColumn(hash_column, row_hash(df, columns))
    return df if "_timestamp" in df.columns and not force else df.withColumn("_timestamp", F.lit(now))


def content_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """MD5 over quoted values joined by the unit separator; NULL and the text NULL differ."""
    quoted = [F.coalesce(F.concat(F.lit("'"), F.replace(F.col(f"`{c}`").cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *quoted))
