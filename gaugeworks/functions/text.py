"""Value-to-text column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def second_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a timestamp in UTC, whatever the session time zone."""
    # Counting up from a zone-less epoch keeps the session zone out of it.
    clock = F.timestamp_add("SECOND", F.unix_seconds(ts), F.expr(_EPOCH))
    return F.replace(clock.cast("string"), F.lit(" "), F.lit("T"))


def instant_text(ts: Column) -> Column:
    """ISO text of a timestamp in UTC with a ``Z``, whatever the session time zone.

    The fraction is left out when zero and otherwise has three or six digits.
    """
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    digits = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.left(digits, F.lit(3))))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(second_text(ts), fraction, F.lit("Z"))


def text_or(column: Column, default: str) -> Column:
    return F.coalesce(column.cast("string"), F.lit(default))
