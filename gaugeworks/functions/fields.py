"""Strict text-to-value column expressions.

Spark's own casts are more lenient than the line format: they trim integers and take ``inf`` and
``nan`` spelled any way. The guards below close those gaps and every reader gives null on bad
text, never an error, with ANSI mode on or off. Everything is a built-in expression, so parsing
stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The line format.
SEPARATORS = ";,"
INTEGER_TEXT = r"\A[+-]?[0-9]+\z"
SPECIAL_DOUBLE_TEXT = r"(?s)\A[\x00-\x20]*[+-]?(NaN|Infinity|[0-9.].*)\z"
TIMESTAMP_FORM = "0000-00-00T00:00:00"
YEAR_ZERO = "0001"
LENIENT_TIMESTAMP_TEXT = (
    r"\A(?!0000)[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
    r"T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]|24:00:00)\z"
)
# End of fixed values.


def split_fields(line: Column) -> Column:
    """Split on either separator; empty fields at the end of the line do not count.

    One literal separator keeps ``split`` on its fast path, so the second is replaced first.
    """
    first, second = SEPARATORS
    trimmed = F.rtrim(line, F.lit(SEPARATORS))
    return F.split(F.replace(trimmed, F.lit(second), F.lit(first)), first, -1)


def field(fields: Column, position: int) -> Column:
    """Text at ``position``; null when the line is too short. May be empty."""
    return F.get(fields, F.lit(position))


def last_field(fields: Column) -> Column:
    return F.try_element_at(fields, F.lit(-1))


# The readers take a field that may be empty and give null for it. They mention their input as
# rarely as they can: all columns of a reading are one generated method, which the JVM leaves
# uncompiled beyond 8000 bytes.


def to_text(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def to_int(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("int"))


def to_long(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))


def to_double(text: Column) -> Column:
    """Double, null on bad text. Only texts with an ``n`` (NaN, Infinity) need their spelling
    checked; the rest goes straight to the cast, which is the cheap way."""
    named = text.contains("n") | text.contains("N")
    readable = (text != "") & (~named | text.rlike(SPECIAL_DOUBLE_TEXT))
    return F.when(readable, text.try_cast("double"))


def to_timestamp_utc(text: Column) -> Column:
    """Second-resolution UTC date-time, whatever the session time zone.

    Days 29 to 31 past the end of a month mean its last day, and 24:00:00 the next midnight;
    other impossible dates give null. Only text the plain cast refuses gets that far.
    """
    keep = F.lit(None)
    well_formed = F.mask(text, keep, keep, F.lit("0"), keep) == TIMESTAMP_FORM
    zoned = F.concat(text, F.lit("Z"))
    plain = F.when(well_formed & (text > YEAR_ZERO), zoned.try_cast("timestamp"))

    def number(position: int) -> Column:
        return F.substring(text, position, 2).try_cast("int")

    month_start = F.concat(F.substring(text, 1, 8), F.lit("01")).try_cast("date")
    date = F.least(F.date_add(month_start, number(9) - 1), F.last_day(month_start))
    of_day = number(12) * 3600 + number(15) * 60 + number(18)
    lenient = F.timestamp_seconds(F.unix_date(date).cast("bigint") * 86_400 + of_day)
    return F.coalesce(plain, F.when(text.rlike(LENIENT_TIMESTAMP_TEXT), lenient))


READERS = {
    "int": to_int,
    "string": to_text,
    "double": to_double,
    "timestamp": to_timestamp_utc,
}
