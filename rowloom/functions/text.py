"""Text helpers: whitespace handling, number and timestamp rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters counted as whitespace when values are stripped or collapsed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same as a regular expression. Listed, since (?U) looks up every character's properties.
WHITESPACE_RUN = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# Text without any of these is stripped and has no run but single spaces.
UNEVEN = "^ | $|  |[^ -~]"

TIME_TYPES = (T.TimestampType, T.TimestampNTZType)


def strip(value: Column) -> Column:
    """Remove whitespace of any kind at both ends.

    Most cells begin and end with a printable ASCII character; only the others are trimmed.
    """
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    suspect = (first <= " ") | (first > "~") | (last <= " ") | (last > "~")
    return F.when(suspect, F.btrim(value, F.lit(WHITESPACE))).otherwise(value)


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def collapse(value: Column) -> Column:
    """Strip, then replace every inner whitespace run by one space.

    Most cells are printable ASCII with single spaces inside; only the others are changed.
    """
    return F.when(value.rlike(UNEVEN), F.regexp_replace(strip(value), WHITESPACE_RUN, " ")).otherwise(value)


def number_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a number; doubles from 1e-4 to 1e16 without an exponent."""
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.cast("string")
    size = F.abs(value)

    def expanded(digits: str) -> Column:
        return F.regexp_replace(value.try_cast(digits).cast("string"), r"(\.[0-9]+?)0+$", "$1")

    return (
        F.when((size >= 1e7) & (size < 1e16), expanded("decimal(38,18)"))
        .when((size >= 1e-4) & (size < 1e-3), expanded("decimal(38,24)"))
        .otherwise(value.cast("string"))
    )


def iso_text(value: Column) -> Column:
    """ISO text of a timestamp; microseconds only where there are any."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Render one typed cell the way a raw landing file holds it."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.NumericType):
        return number_text(value, dtype)
    if isinstance(dtype, TIME_TYPES):
        return iso_text(value)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")
