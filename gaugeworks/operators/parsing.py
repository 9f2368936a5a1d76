"""Lines to typed readings (one reader per sensor kind)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.functions.fields import READERS, field, last_field, split_fields, to_long
from gaugeworks.schemas import STAMP, layout

_FIELDS = "_fields"


def reading_columns(fields: Column, kind: str) -> list[Column]:
    """Typed columns of a reading, from its already split fields."""
    columns = [
        READERS[tp](field(fields, position)).alias(name)
        for position, (name, tp) in enumerate(layout(kind))
    ]
    stamp = F.coalesce(to_long(last_field(fields)), F.lit(0).cast("bigint"))
    return columns + [stamp.alias(STAMP)]


def parse_readings(
    lines: DataFrame,
    kind: str,
    keep: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Parse each line as a reading of ``kind``; ``keep`` columns pass through.

    The split is exploded from a one-element array, which the optimizer does not look through:
    otherwise every later null filter would be moved below the split and repeat it per field.
    Typed columns that are not used later are still pruned, but those that are filtered on are
    read twice. With ``columns`` just these are parsed, once each: the whole reading is then
    what is exploded.
    """
    split = lines.select(*keep, F.explode(F.array(split_fields(F.col("value")))).alias(_FIELDS))
    parsed = reading_columns(F.col(_FIELDS), kind)
    if columns is None:
        return split.select(*keep, *parsed)
    names = [name for name, _ in layout(kind)] + [STAMP]
    unknown = set(columns) - set(names)
    if unknown:
        raise ValueError(f"a {kind} reading has no {sorted(unknown)}")
    wanted = [column for name, column in zip(names, parsed) if name in columns]
    return split.select(*keep, F.inline(F.array(F.struct(*wanted))))


def parse_base(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return parse_readings(lines, "base", keep)


def parse_pms7003(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return parse_readings(lines, "pms7003", keep)


def parse_bmp280(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return parse_readings(lines, "bmp280", keep)


def parse_bme280(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return parse_readings(lines, "bme280", keep)
