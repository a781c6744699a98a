"""Type names of the source dialects and what the target makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source type names by the target type they become.
TYPE_MAPS: dict[str, dict[str, str]] = {
    "mysql": {
        "int": "INTEGER", "integer": "INTEGER", "bigint": "BIGINT", "smallint": "INTEGER", "mediumint": "INTEGER", "tinyint": "INTEGER", "year": "INTEGER",
        "bit": "BOOLEAN", "bool": "BOOLEAN", "boolean": "BOOLEAN", "float": "REAL", "double": "DOUBLE PRECISION", "double precision": "DOUBLE PRECISION",
        "decimal": "NUMERIC", "dec": "NUMERIC", "numeric": "NUMERIC", "fixed": "NUMERIC",
        "char": "TEXT", "varchar": "VARCHAR", "tinytext": "TEXT", "text": "TEXT", "mediumtext": "TEXT", "longtext": "TEXT", "enum": "TEXT", "set": "TEXT", "binary": "TEXT", "varbinary": "TEXT",
        "blob": "BYTEA", "tinyblob": "BYTEA", "mediumblob": "BYTEA", "longblob": "BYTEA", "date": "DATE", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "time": "TIME", "json": "JSONB",
    },
    "postgres": {
        "smallint": "INTEGER", "integer": "INTEGER", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "real": "REAL", "double precision": "DOUBLE PRECISION", "numeric": "NUMERIC", "decimal": "NUMERIC",
        "money": "TEXT", "character varying": "VARCHAR", "character": "TEXT", "text": "TEXT", "citext": "TEXT", "uuid": "TEXT", "bytea": "BYTEA", "json": "JSONB", "jsonb": "JSONB",
        "date": "DATE", "timestamp without time zone": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP", "time without time zone": "TIME", "time with time zone": "TIME",
        "interval": "TEXT", "bit": "TEXT", "bit varying": "TEXT", "xml": "TEXT", "inet": "TEXT", "cidr": "TEXT", "macaddr": "TEXT", "macaddr8": "TEXT", "tsvector": "TEXT", "tsquery": "TEXT",
        "point": "TEXT", "line": "TEXT", "lseg": "TEXT", "box": "TEXT", "path": "TEXT", "polygon": "TEXT", "circle": "TEXT", "array": "TEXT", "user-defined": "TEXT",
    },
    "mssql": {
        "int": "INTEGER", "integer": "INTEGER", "bigint": "BIGINT", "smallint": "INTEGER", "tinyint": "INTEGER", "bit": "BOOLEAN", "float": "DOUBLE PRECISION", "real": "REAL",
        "decimal": "NUMERIC", "numeric": "NUMERIC", "money": "NUMERIC", "smallmoney": "NUMERIC",
        "char": "TEXT", "varchar": "VARCHAR", "nchar": "TEXT", "nvarchar": "TEXT", "text": "TEXT", "ntext": "TEXT", "binary": "TEXT", "varbinary": "TEXT", "image": "TEXT", "uniqueidentifier": "TEXT", "xml": "TEXT",
        "date": "DATE", "datetime": "TIMESTAMP", "datetime2": "TIMESTAMP", "smalldatetime": "TIMESTAMP", "datetimeoffset": "TIMESTAMP", "time": "TIME", "json": "JSONB",
    },
}
# Types read as text whatever they look like, encodings tried in order, types of two-byte text, by dialect.
TEXT_TYPES: dict[str, tuple[str, ...]] = {
    "mysql": ("char", "varchar", "tinytext", "text", "mediumtext", "longtext", "enum", "set", "binary", "varbinary"),
    "postgres": ("character varying", "character", "text", "citext", "uuid"),
    "mssql": ("char", "varchar", "nchar", "nvarchar", "text", "ntext", "xml"),
    "firebird": (),
}
ENCODINGS: dict[str, tuple[str, ...]] = {"mysql": ("utf-8",), "postgres": ("utf-8",), "mssql": ("cp1250", "utf-8", "latin-1"), "firebird": ("cp1250", "utf-8", "latin-1")}
NCHAR_TYPES = ("nchar", "nvarchar", "ntext")
FEATURES: dict[str, frozenset[str]] = {
    "mysql": frozenset({"keyset", "hash_diff"}),
    "postgres": frozenset({"keyset", "hash_diff"}),
    "mssql": frozenset({"keyset", "hash_diff", "partition_by_source"}),
    "firebird": frozenset({"keyset", "parent_incremental"}),
}
SPARK_TYPES: dict[str, T.DataType] = {
    "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "REAL": T.FloatType(), "DOUBLE PRECISION": T.DoubleType(), "NUMERIC": T.DecimalType(38, 18), "TEXT": T.StringType(), "VARCHAR": T.StringType(),
    "BYTEA": T.BinaryType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIME": T.StringType(), "JSONB": T.StringType(),
}


def map_type(dialect: str, source_type: str, subtype: int = 0, scale: int = 0) -> str:
    """The target's type; an unknown one is TEXT. Firebird's types are numbers with a subtype and a scale."""
    if dialect == "firebird":
        return firebird_type(int(source_type), subtype, scale)
    return TYPE_MAPS[dialect].get(source_type.lower(), "TEXT")


def firebird_type(code: int, subtype: int = 0, scale: int = 0) -> str:
    if code in (7, 8):
        return "NUMERIC" if scale < 0 else "INTEGER"
    if code == 16:
        return "NUMERIC" if scale < 0 or subtype in (1, 2) else "BIGINT"
    if code == 261:
        return "TEXT" if subtype == 1 else "BYTEA"
    return {10: "REAL", 11: "DOUBLE PRECISION", 27: "DOUBLE PRECISION", 12: "DATE", 13: "TIME", 14: "TEXT", 37: "VARCHAR", 40: "TEXT", 23: "BOOLEAN", 35: "TIMESTAMP"}.get(code, "TEXT")


def map_type_expr(dialect: str, c: Column) -> Column:
    pairs = [x for k, v in TYPE_MAPS[dialect].items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(c)), F.lit("TEXT"))


def firebird_type_expr(code: Column, subtype: Column, scale: Column) -> Column:
    wide = F.when((scale < 0) | subtype.isin(1, 2), "NUMERIC").otherwise("BIGINT")
    out = F.when(code.isin(7, 8), F.when(scale < 0, "NUMERIC").otherwise("INTEGER")).when(code == 16, wide).when(code == 261, F.when(subtype == 1, "TEXT").otherwise("BYTEA"))
    for k in (10, 11, 27, 12, 13, 14, 37, 40, 23, 35):
        out = out.when(code == k, firebird_type(k))
    return out.otherwise("TEXT")


def describe(df: DataFrame) -> list[tuple[str, str, bool, int]]:
    """(name, type, nullable, ordinal) of each column, in the source's order; none is an error."""
    if not df.columns:
        raise ValueError("the source has no columns")
    return [(f.name, f.dataType.simpleString(), f.nullable, i + 1) for i, f in enumerate(df.schema.fields)]


def as_text(df: DataFrame, source_types: dict[str, str], dialect: str) -> DataFrame:
    """Columns of the dialect's text types as strings, whatever they were read as."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if source_types.get(c, "").lower() in TEXT_TYPES[dialect] else F.col(f"`{c}`") for c in df.columns])


def target_types(dialect: str, source_types: dict[str, str]) -> dict[str, str]:
    """Target type of each declared column; a Firebird type is written as code, subtype, scale."""
    numbers = lambda t: tuple(int(x) for x in str(t).replace(",", " ").split())
    return {c: firebird_type(*numbers(t)) if dialect == "firebird" else map_type(dialect, t) for c, t in source_types.items()}


def cast_target(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Cleaned columns as the target's types hold them; a decimal keeps its own scale, an array or struct its form."""
    def one(f: T.StructField) -> Column:
        c, t = F.col(f"`{f.name}`"), SPARK_TYPES.get(targets.get(f.name, ""))
        if t is None or t == f.dataType or (isinstance(t, T.DecimalType) and isinstance(f.dataType, T.DecimalType)) or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return c
        return c.cast(t).alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def restore_case(df: DataFrame, declared: list[str]) -> DataFrame:
    """Columns that a driver lower-cased get their declared names back."""
    by = {d.lower(): d for d in declared}
    return df.toDF(*[by.get(c.lower(), c) for c in df.columns])
