"""Scalar cleaning: strict and lenient casts, replacement, codes, ids, time units, points, national ids."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableError

TRUE_WORDS = ("true", "1", "on", "yes")
FALSE_WORDS = ("false", "0", "off", "no", "")
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
TIME = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,6})?)?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$"
TIME_UNIT = r"^([0-9]+)([YMQWDHTSLUN])$"


def swap(column: Column, old: object, new: object) -> Column:
    """``new`` where the value equals ``old``; null equals null, and NaN equals NaN."""
    same = column.eqNullSafe(F.lit(old)) if not (isinstance(old, float) and old != old) else F.isnan(column)
    return F.when(same, F.lit(new)).otherwise(column)


def replace_values(column: Column, mapping: Mapping[object, object]) -> Column:
    """The mapped value, or the value itself where there is none."""
    out = F.when(F.lit(False), column)
    for old, new in mapping.items():
        out = out.when(column.eqNullSafe(F.lit(old)), F.lit(new))
    return out.otherwise(column)


def map_enum(column: Column, mapping: Mapping[str, object], strict: bool = True) -> Column:
    """Prepared values of source codes; null passes. A code without a value raises, or gives null if not strict."""
    out = F.when(column.isNull(), F.lit(None))
    for code, value in mapping.items():
        out = out.when(column == F.lit(code), F.lit(value))
    return out.otherwise(F.raise_error(F.concat(F.lit("not in the enum: "), column.cast("string")))) if strict else out


def enum_codes(mapping: Mapping[str, object], value: object) -> list[str]:
    """The source codes of a prepared value, for a filter by it."""
    codes = [code for code, v in mapping.items() if v == value]
    if not codes:
        raise TableError(f"{value!r} is not in the enum")
    return codes


def split(column: Column, separator: str) -> Column:
    """Parts around a literal separator; null stays null."""
    return F.split(column, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def from_base64(column: Column, text: bool = True) -> Column:
    """Decoded text or bytes; null where the text is no base64."""
    raw = F.try_to_binary(column, F.lit("base64"))
    return F.decode(raw, "UTF-8") if text else raw


def cast_to(column: Column, dtype: T.DataType, to: str) -> Column:
    """Strict cast of a column of Spark type ``dtype``; null where the value has no such form.

    To string, null becomes ``""`` and lists, maps and objects become JSON. To integer, a number may have no fraction
    above 0. A datetime gives its date, or its time as text.
    """
    nested = isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))
    text = F.trim(column.cast("string")) if not nested else F.to_json(column)
    exact = column.cast("string") if not nested else text
    if to == "string":
        return F.coalesce(exact, F.lit(""))
    if to == "integer":
        if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            return F.when(column - F.floor(column) > 0, F.lit(None)).otherwise(column.try_cast("long"))
        if isinstance(dtype, T.IntegralType):
            return column.cast("long")
        return F.when(exact.rlike(INTEGER), exact.try_cast("long"))
    if to == "number":
        return column.cast("double") if isinstance(dtype, T.NumericType) else F.when(text.rlike(NUMBER), text.try_cast("double"))
    if to == "boolean":
        if isinstance(dtype, T.BooleanType):
            return column
        word = F.lower(exact)
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if to == "date":
        return F.to_date(column) if isinstance(dtype, (T.TimestampType, T.DateType)) else F.when(exact.rlike(DATETIME), F.substring(exact, 1, 10).try_cast("date"))
    if to == "datetime":
        return column.cast("timestamp") if isinstance(dtype, (T.TimestampType, T.DateType)) else F.when(exact.rlike(DATETIME), exact.try_cast("timestamp"))
    if to == "time":
        return F.date_format(column, "HH:mm:ss") if isinstance(dtype, T.TimestampType) else F.when(exact.rlike(TIME), exact)
    raise TableError(f"can't cast to {to!r}")


def cast_strict(df: DataFrame, column: str, to: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows whose value has the form, cast, and the rejected rows as they were."""
    value = cast_to(F.col(column), df.schema[column].dataType, to)
    bad = F.col(column).isNotNull() & value.isNull()
    return df.filter(~bad).withColumn(name or column, value), df.filter(bad)


def cast_or_fail(df: DataFrame, column: str, to: str) -> Column:
    """Like :func:`cast_to`, but a value without the form fails the query."""
    value = cast_to(F.col(column), df.schema[column].dataType, to)
    return F.when(F.col(column).isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{column} is no {to}: "), F.col(column).cast("string")))).otherwise(value)


def clean_number(column: Column) -> Column:
    """A number from loose text: one comma and no dot is a decimal comma, other commas part thousands; null if none."""
    text = F.trim(column)
    commas = F.length(text) - F.length(F.regexp_replace(text, ",", ""))
    decimal_comma = (commas == 1) & ~text.contains(".")
    plain = F.when(decimal_comma, F.regexp_replace(text, ",", ".")).otherwise(F.regexp_replace(text, ",", ""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def clean(column: Column, to: str) -> Column:
    """Lenient cast of text: numbers as :func:`clean_number`, the rest as the strict cast, NaN and what fits not as null."""
    text = F.when(F.lower(F.trim(column)) != "nan", column)
    if to == "number":
        return clean_number(text)
    if to == "integer":
        number = clean_number(text)
        return F.when(number == F.floor(number), number.try_cast("long"))
    return cast_to(text, T.StringType(), to)


def point(x: Column, y: Column) -> Column:
    """``POINT (x y)``."""
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


NUM = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def flip(wkt: Column, times: int = 1) -> Column:
    """x and y of every coordinate swapped, an SRID prefix kept; an even number of flips is none. 3-D gives null."""
    if times % 2 == 0:
        return wkt
    flat = ~wkt.rlike(rf"{NUM}\s+{NUM}\s+{NUM}")
    return F.when(flat, F.regexp_replace(wkt, rf"{NUM}\s+{NUM}", "$2 $1"))


def geometry_label(wkt: Column) -> Column:
    """A point's text, or the upper-case name of another shape."""
    body = F.regexp_replace(wkt, r"^SRID=[0-9]+;\s*", "")
    kind = F.upper(F.regexp_extract(body, r"^\s*([A-Za-z]+)", 1))
    return F.when(kind == "POINT", body).otherwise(kind)


def centroid_link(x: Column, y: Column) -> Column:
    """A map link at a WGS84 point, x being the longitude."""
    return F.format_string("https://www.openstreetmap.org/?mlat=%s&mlon=%s#map=19/%s/%s", y.cast("string"), x.cast("string"), y.cast("string"), x.cast("string"))


def negative(column: Column) -> Column:
    return -column


def composite_id(*columns: Column, strict: bool = True) -> Column:
    """Comma-joined key text; null if a part is null. A part with a comma, or a leading ``/ @ : ?``, raises, or gives null."""
    parts = [c.cast("string") for c in columns]
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.contains(",")
    bad = bad | parts[0].rlike(r"^[/@:?]")
    joined = F.concat(*[x for p in parts for x in (F.lit(","), p)][1:])
    return F.when(bad, F.raise_error(F.concat(F.lit("no id can hold: "), joined)) if strict else F.lit(None)).otherwise(joined)


def split_id(column: Column) -> Column:
    return F.split(column, ",")


def parse_time_unit(unit: Column) -> Column:
    """``number, unit`` of texts like ``14D``; null if malformed."""
    ok = unit.rlike(TIME_UNIT)
    return F.when(ok, F.struct(F.regexp_extract(unit, TIME_UNIT, 1).try_cast("long").alias("number"), F.regexp_extract(unit, TIME_UNIT, 2).alias("unit")))


def is_national_id(column: Column, today: Column | None = None) -> Column:
    """Whether text is a Lithuanian personal code: 11 digits, a birth date that exists and isn't ahead, check digit.

    Any 11 digits with a leading 9 are one. A birth date with a year, month or day of 00 is unknown and not looked at; the
    century is 17 and half the first digit. The check digit is the weighted sum modulo 11; if that is 10, a second set of
    weights decides, modulo 10.
    """
    digit = [F.substring(column, i + 1, 1).try_cast("int") for i in range(11)]
    weigh = lambda ws: sum((digit[i] * w for i, w in enumerate(ws)), F.lit(0))
    first, second = weigh((1, 2, 3, 4, 5, 6, 7, 8, 9, 1)) % 11, weigh((3, 4, 5, 6, 7, 8, 9, 1, 2, 3)) % 10
    check = F.when(first != 10, first).otherwise(second)
    pairs = [F.substring(column, i, 2) for i in (2, 4, 6)]
    born = F.concat((17 + F.floor(digit[0] / 2)).cast("string"), F.concat_ws("-", *pairs)).try_cast("date")
    known = reduce(lambda a, b: a & b, [p != "00" for p in pairs])
    dated = ~known | (born.isNotNull() & (born <= (F.current_date() if today is None else today)))
    return F.coalesce(column.rlike(r"^[0-9]{11}$") & ((digit[0] == 9) | (dated & (check == digit[10]))), F.lit(False))
