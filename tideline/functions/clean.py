"""Value cleaning as Column expressions. Every function is NULL for a missing value (NULL or NaN).

`kind` says what the column holds: "text", "int", "float", "decimal" or "bool". Nothing here is a
UDF but decode_bytes for other encodings than UTF-8, which no built-in function tries in turn.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the cleaning rules.
NULL_WORDS = ("", "nan", "none", "null")
INVALID_DATES = ("0000-00-00", "9999-12-31")
INVALID_DATETIMES = ("0000-00-00 00:00:00", "0000-00-00T00:00:00", "9999-12-31 00:00:00", "9999-12-31 23:59:59", "9999-12-31T00:00:00", "9999-12-31T23:59:59")
INVALID_DATE_PATTERN = r"^(0000-00-00|0000-00-00 00:00:00|0000-00-00T00:00:00.*|9999-12-31.*)$"
TRUE_WORDS = ("true", "1", "yes", "ano", "t")
FALSE_WORDS = ("false", "0", "no", "ne", "f")
TRUTHY_WORDS = ("true", "t", "1", "yes", "y", "ano", "a")
DATE_LIKE_TYPES = ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "timestamp", "timestamp without time zone", "timestamp with time zone")
DATE_NAME_HINTS = ("date", "datum", "cas", "time")
INTEGER_TYPES = ("INTEGER", "BIGINT", "SMALLINT", "MEDIUMINT")
TIME_TYPES = ("time", "time without time zone", "time with time zone")
EXACT_FLOAT_LIMIT = 2**53

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def missing(c: Column, kind: str = "text") -> Column:
    return c.isNull() | F.isnan(c) if kind == "float" else c.isNull()


def _whole(d: Column) -> Column:
    """A double as a bigint if it is integral and in range."""
    ok = ~F.isnan(d) & (F.abs(d) < F.lit(9.2233720368547758e18)) & (d == F.floor(d))
    return F.when(ok, d.cast("bigint"))


def _text_number(c: Column) -> Column:
    """The double that text spells; single underscores between digits are allowed."""
    t = F.regexp_replace(strip(c), r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(t.rlike(_NUMBER), t).try_cast("double")


def to_int_or_none(c: Column, kind: str = "text") -> Column:
    """Integral values as bigint; others, also decimals, NULL. Beyond 64 bits: NULL."""
    if kind == "text":
        return _whole(_text_number(c))
    if kind == "float":
        return _whole(c.cast("double"))
    if kind == "decimal":
        return F.lit(None).cast("bigint")
    return c.cast("bigint")


def to_int_or_na(c: Column, kind: str = "text") -> Column:
    """As to_int_or_none, but decimals count by their value."""
    return _whole(c.cast("double")) if kind == "decimal" else to_int_or_none(c, kind)


def to_str_or_none(c: Column, kind: str = "text") -> Column:
    """Text, not stripped; blank and `nan` are NULL; an integral float has no decimal part."""
    if kind == "float":
        return F.when(missing(c, kind), None).otherwise(F.coalesce(_whole(c).cast("string"), c.cast("string")))
    if kind == "bool":
        return F.when(c, "True").when(~c, "False")
    text = c.cast("string")
    return F.when((strip(text) == "") | (F.lower(strip(text)) == "nan"), None).otherwise(text)


def to_bool(c: Column, kind: str = "text") -> Column:
    """The words above, in any case; of numbers, whether the integral part is not 0."""
    if kind == "text":
        t = F.lower(strip(c))
        return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)
    if kind == "float":
        return F.when(~missing(c, kind), F.abs(c) >= 1)
    if kind == "decimal":
        return F.lit(None).cast("boolean")
    return c.cast("boolean")


#: Spellings beside ISO's, and how each is written as an ISO date; month first, and day first where the month would be over 12.
_SPELLINGS = (
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", "$1-$2-$3 $4:$5:$6"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"),
    (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "$1-$2-$3"),
    (r"^(1[3-9]|2[0-9]|3[01])[/.-]([0-9]{1,2})[/.-]([0-9]{4})", "$3-$2-$1"),
    (r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})", "$3-$1-$2"),
    (r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}[0-9:.]*)(Z|[+-][0-9]{2}:?[0-9]{2})$", "$1"),
)
_WHOLE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?$"


def parse_stamp(text: Column) -> Column:
    """Stripped text as a timestamp: ISO dates, ISO date and time with a space or T, whose zone is left out, and the
    spellings above. Anything else is NULL, and so are times outside 1677-09-22 .. 2262-04-11. Each step refers to
    the one before it once, so that the expression stays short however it is nested."""
    for spelling, iso in _SPELLINGS:
        text = F.regexp_replace(text, spelling, iso)
    stamp = F.replace(F.regexp_extract(text, _WHOLE, 0), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    first, past = (F.lit(x).cast("timestamp_ntz") for x in ("1677-09-22", "2262-04-11"))
    return F.get(F.filter(F.array(stamp), lambda x: (x >= first) & (x < past)), 0)


def to_date_str(c: Column) -> Column:
    t = strip(c)
    return F.date_format(parse_stamp(F.when(~t.isin("", *INVALID_DATES), t)), "yyyy-MM-dd")


def to_datetime_str(c: Column) -> Column:
    """Seconds precision; a fraction is dropped."""
    t = strip(c)
    return F.date_format(parse_stamp(F.when(~t.isin("", *INVALID_DATETIMES), t)), "yyyy-MM-dd HH:mm:ss")


def _clock(seconds: Column) -> Column:
    """H:MM:SS of whole seconds by floor division, so that -60 is -1:59:00."""
    hours = F.floor(seconds / 3600)
    rest = F.pmod(seconds, F.lit(3600))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    shown = F.when(hours.between(0, 9), two(hours)).otherwise(hours.cast("string"))
    return F.concat_ws(":", shown, two(F.floor(rest / 60)), two(F.pmod(rest, F.lit(60))))


def to_time_str(c: Column, kind: str = "text") -> Column:
    """H:MM:SS kept, `N days H:MM:SS` cut to its time; a negative time and numbers, which are seconds, by floor
    division; a number given as text is nanoseconds."""
    if kind != "text":
        number = F.when(~missing(c, kind), c) if kind == "float" else c
        return F.when(number.isNotNull(), _clock(number.cast("bigint")))
    t = strip(c)
    tail = F.regexp_extract(t, r"^([0-9]+ days )?([0-9]{1,2}:[0-9]{2}:[0-9]{2})$", 2)
    part = lambda k: F.regexp_extract(t, r"^-([0-9]+):([0-9]{2}):([0-9]{2})$", k)
    negative = -(part(1).try_cast("bigint") * 3600 + part(2).try_cast("bigint") * 60 + part(3).try_cast("bigint"))
    nanos = F.when(t.rlike(r"^-?[0-9]+([.][0-9]+)?$"), t).try_cast("double") / 1e9
    return F.when(tail != "", tail).when(part(1) != "", _clock(negative)).when(nanos.isNotNull(), _clock(nanos.cast("bigint")))


def escape_ascii(c: Column) -> Column:
    """Characters over ASCII as \\uXXXX, pairs of surrogates for those over U+FFFF."""
    def one(x: Column) -> Column:
        units = F.lower(F.hex(F.encode(x, "UTF-16BE")))
        both = F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise(""))
        return F.when(F.octet_length(x) == 1, x).otherwise(both)

    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def to_json_text(c: Column, structured: bool = False, ensure_ascii: bool = True) -> Column:
    """JSON of maps, arrays and structs; the text of anything else."""
    if not structured:
        return c.cast("string")
    return escape_ascii(F.to_json(c)) if ensure_ascii else F.to_json(c)


def fmt_int_for_csv(c: Column, kind: str = "text") -> Column:
    """to_int_or_none as text; a decimal is an empty text, not NULL."""
    if kind == "decimal":
        return F.when(c.isNotNull(), F.lit(""))
    return to_int_or_none(c, kind).cast("string")


def bytes_to_hex_literal(c: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(c)))


def decode_bytes(c: Column, encodings: Sequence[str] = ("utf-8",)) -> Column:
    """The first encoding that decodes the value; with the last, what does not decode is replaced. UTF-8 first or alone is
    built in; other orders are an Arrow function."""
    tried = tuple(encodings)
    valid = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    if tried == ("utf-8",):
        return F.make_valid_utf8(c.cast("string"))

    @F.pandas_udf(T.StringType())
    def decode(s: pd.Series) -> pd.Series:
        def one(b):
            for e in tried:
                try:
                    return bytes(b).decode(e)
                except UnicodeDecodeError:
                    pass
            return bytes(b).decode(tried[-1], errors="replace")

        return s.map(one, na_action="ignore")

    return F.coalesce(valid, decode(F.when(valid.isNull(), c))) if tried[0] == "utf-8" else decode(c)


#: Letters without a decomposition that the single-byte code pages hold a base letter for.
_BASE_LETTERS = {"ø": "o", "Ø": "O", "æ": "a", "Æ": "A", "ħ": "h", "ı": "i", "ŧ": "t"}


def narrow_text(c: Column, encoding: str = "cp1250") -> Column:
    """Text as a single-byte code page holds it: other letters become their base letter where there is one, else `?`. Plain
    ASCII is left as it is; an Arrow function makes the rest."""
    @F.pandas_udf(T.StringType())
    def narrow(s: pd.Series) -> pd.Series:
        def letter(x: str) -> str:
            for y in (x, _BASE_LETTERS.get(x, ""), unicodedata.normalize("NFKD", x)[:1]):
                try:
                    if y and y.encode(encoding):
                        return y
                except UnicodeEncodeError:
                    pass
            return "?"

        return s.map(lambda x: "".join(map(letter, x)), na_action="ignore")

    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, c).otherwise(narrow(F.when(~plain, c)))


def decode_bytes_columns(df: DataFrame, encodings: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Binary columns as text, but for those in skip, whose target holds bytes."""
    binary = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)} - set(skip)
    return df.select(*[decode_bytes(F.col(f"`{c}`"), encodings).alias(c) if c in binary else F.col(f"`{c}`") for c in df.columns])


def clean_invalid_date(c: Column) -> Column:
    """Stripped text if it is a date, and no sentinel; numbers given as text pass."""
    t = strip(c)
    ok = parse_stamp(t).isNotNull()
    return F.when((t != "") & ~t.rlike(INVALID_DATE_PATTERN) & ok, t)


def fix_invalid_dates(c: Column) -> Column:
    """Sentinels, then what is no date, then `0` and empty text become NULL."""
    t = strip(c)
    return F.when(t.isin("", "0") | t.rlike(INVALID_DATE_PATTERN) | parse_stamp(t).isNull(), None).otherwise(c)


def date_columns_by_name(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(h in n.lower() for h in DATE_NAME_HINTS)]


def date_like_columns(types: dict[str, str]) -> list[str]:
    """Columns whose source type is a date or a date with time."""
    return [c for c, t in types.items() if t.lower() in DATE_LIKE_TYPES]


def declared_text_types(types: dict[str, str | None]) -> dict[str, str]:
    """Source types by column for those that are read as declared: generated and unnamed ones are left out."""
    return {c: t for c, t in types.items() if t and t.lower() not in ("generated", "nan")}


def normalize_carriage_returns(c: Column) -> Column:
    """CR LF becomes LF; a lone CR becomes a space."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit(" "))


def empty_to_null(c: Column) -> Column:
    """What every text column becomes at the sink, after hashing."""
    return F.nullif(c, F.lit(""))


def integer_precision_guard(c: Column) -> Column:
    """A double bound for an integer column; fails above 2**53, which itself passes."""
    return F.when(F.abs(c) > F.lit(float(EXACT_FLOAT_LIMIT)), F.raise_error(F.concat(F.lit("strict_integer_precision: "), c.cast("string"))).cast("bigint")).otherwise(c.cast("bigint"))


def array_literal(c: Column) -> Column:
    """{a,b}, as an array column takes it; NULL members are NULL."""
    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NULL")))), F.lit("}"))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    return "decimal" if isinstance(dtype, T.DecimalType) else "text"


def fix_column(c: Column, dtype: T.DataType, target: str) -> Column:
    """By the target's type name, in its own case: integers, dates, times, booleans, JSON; anything else is text."""
    kind = kind_of(dtype)
    if target in INTEGER_TYPES:
        return to_int_or_na(c, kind)
    if target in ("DATE", "DATETIME", "TIMESTAMP"):
        text = c if isinstance(dtype, T.StringType) else c.cast("string") if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast("string")
        return to_date_str(text) if target == "DATE" else to_datetime_str(F.substring(text, 1, 19))
    if target == "BOOLEAN":
        return to_bool(c, kind)
    if target == "JSONB":
        return to_json_text(c, isinstance(dtype, (T.MapType, T.ArrayType, T.StructType)))
    if target == "TIME":
        return c
    return to_str_or_none(c, kind)


def prepare_export(df: DataFrame, targets: dict[str, str], deleted: str = "_deleted_in_source", stamp: str = "_timestamp", now: str | None = None, strict: bool = False) -> DataFrame:
    """All cleaning in one projection, in this order for each column: date sentinels, times, integers,
    types of the target, carriage returns. Missing targets become NULL columns; columns that begin
    with `_mage_` go; the deletion flag is false and the stamp is `now`."""
    out = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, target in targets.items():
        if name in (deleted, stamp):
            continue
        if name not in types:
            out.append(F.lit(None).cast("string").alias(name))
            continue
        c, t = F.col(f"`{name}`"), types[name]
        if isinstance(t, T.StringType) and target in ("DATE", "DATETIME", "TIMESTAMP"):
            c = fix_invalid_dates(c)
        if target == "TIME":
            c = to_time_str(c, kind_of(t))
        elif strict and target in INTEGER_TYPES and kind_of(t) == "float":
            c = integer_precision_guard(c)
        else:
            c = fix_column(c, t, target)
        if isinstance(t, T.StringType) and target not in (*INTEGER_TYPES, "BOOLEAN"):
            c = normalize_carriage_returns(c)
        out.append(c.alias(name))
    rest = [F.col(f"`{n}`") for n in df.columns if n not in targets and n not in (deleted, stamp) and not n.startswith("_mage_")]
    return df.select(*out, *rest, F.lit(False).alias(deleted), F.lit(now).cast("string").alias(stamp))


def is_truthy(value: object) -> bool:
    """The one vocabulary for flags in a configuration."""
    if value is None or isinstance(value, bool):
        return bool(value)
    return str(value).strip().lower() in TRUTHY_WORDS
