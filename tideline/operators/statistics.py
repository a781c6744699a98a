"""Column statistics, and the types they suggest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import to_int_or_none

#: 90 percent of the largest INTEGER: beyond it a column is promoted.
PROMOTE_ABOVE = int(2147483647 * 0.9)


def integer_width(lo: Column, hi: Column) -> Column:
    return F.when((lo >= -32768) & (hi <= 32767), "smallint").when((lo >= -2147483648) & (hi <= 2147483647), "integer").otherwise("bigint")


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each text column: nulls, values, integers, other numbers, non-numbers, least and greatest
    integer. One pass for all columns, then one row for each."""
    aggs = []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        number, whole = text.try_cast("double"), to_int_or_none(text)
        aggs += [F.count_if(text.isNull()).alias(f"nulls_{i}"), F.count(text).alias(f"values_{i}"), F.count(whole).alias(f"ints_{i}"), F.count_if(number.isNotNull() & whole.isNull()).alias(f"floats_{i}"), F.count_if(text.isNotNull() & number.isNull()).alias(f"others_{i}"), F.min(whole).alias(f"lo_{i}"), F.max(whole).alias(f"hi_{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{i}").alias(a) for n, a in (("nulls", "nulls"), ("values", "n"), ("ints", "integers"), ("floats", "floats"), ("others", "non_numeric"), ("lo", "int_min"), ("hi", "int_max"))]) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def suggest_types(statistics: DataFrame) -> DataFrame:
    """column and pg_type from column_statistics."""
    kind = F.when(F.col("n") == 0, "text").when(F.col("non_numeric") > 0, "text").when(F.col("floats") > 0, "double precision").otherwise(integer_width(F.col("int_min"), F.col("int_max")))
    return statistics.select("column", kind.alias("pg_type"))


def promote(df: DataFrame, integers: Sequence[str], enums: Sequence[str] = ()) -> DataFrame:
    """(column, pg_type): INTEGER columns become BIGINT near their limit, enum columns of 0 and 1 BOOLEAN."""
    aggs = [F.max(F.col(c).cast("bigint")).alias(f"max_{c}") for c in integers]
    aggs += [F.count_if(~F.col(c).cast("string").isin("0", "1")).alias(f"other_{c}") for c in enums]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.when(F.col(f"max_{c}") > PROMOTE_ABOVE, "BIGINT").otherwise("INTEGER").alias("pg_type")) for c in integers]
    rows += [F.struct(F.lit(c).alias("column"), F.when(F.col(f"other_{c}") == 0, "BOOLEAN").otherwise("TEXT").alias("pg_type")) for c in enums]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def size_estimate(df: DataFrame, sample_rows: int = 100) -> tuple[int, float]:
    """Rows, and megabytes from the mean JSON size of a few rows, a report's figure."""
    rows = df.count()
    mean = df.limit(sample_rows).agg(F.avg(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0.0
    return rows, rows * mean / 1e6


def declared_width(types: Sequence[tuple[str, int | None]]) -> int:
    """Bytes of a row by its declared columns: blob 200, varchar 50, char 10, others 8 unless a length is given; 256 if none."""
    default = {"blob": 200, "varchar": 50, "char": 10}
    return sum(200 if t == "blob" else n or default.get(t, 8) for t, n in types) or 256


def index_columns(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """(index, is_primary, position, column) of a catalog: indexes (index, is_unique, is_primary, numbers, an array of column
    numbers in the key's order) and columns (number, column, nullable). Unique indexes over columns that are never NULL, in
    full, are keys; others are left out."""
    keys = indexes.where("is_unique").select("index", "is_primary", F.size("numbers").alias("width"), F.posexplode("numbers").alias("position", "number"))
    named = keys.join(columns, "number").where(F.col("is_primary") | ~F.col("nullable"))
    whole = named.groupBy("index").agg(F.count("*").alias("n"))
    return named.join(whole, "index").where("n = width").select("index", "is_primary", (F.col("position") + 1).alias("position"), "column")
