"""Reading layouts: which typed columns a line of each sensor kind carries, in order."""

from __future__ import annotations

from pyspark.sql import types as T

# Line layout. Position in the list is the position in the line.
BASE_FIELDS = [
    ("sensor_id", "int"),
    ("sensor_type", "string"),
    ("location", "int"),
    ("lat", "double"),
    ("lon", "double"),
    ("timestamp", "timestamp"),
]
METRIC_FIELDS = {
    "base": [],
    "pms7003": ["p1", "p2", "p0"],
    "bmp280": ["pressure", "altitude", "pressure_at_sea_level", "temperature"],
    "bme280": ["pressure", "altitude", "pressure_at_sea_level", "temperature", "humidity"],
}
STAMP = "datagen_ts"
HEADER_PREFIX = "sensor_id"
# End of fixed values.

# The measured value a reading of each kind is useless without.
MAIN_METRIC = {"base": None, "pms7003": "p1", "bmp280": "temperature", "bme280": "temperature"}

_SPARK_TYPES = {
    "int": T.IntegerType(),
    "string": T.StringType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def layout(kind: str) -> list[tuple[str, str]]:
    """Ordered ``(column, type)`` pairs of a line of ``kind``, without the trailing stamp."""
    if kind not in METRIC_FIELDS:
        raise ValueError(f"unknown sensor kind {kind!r}; expected one of {sorted(METRIC_FIELDS)}")
    return BASE_FIELDS + [(name, "double") for name in METRIC_FIELDS[kind]]


def reading_schema(kind: str) -> T.StructType:
    """Schema of parsed readings of ``kind``."""
    fields = [T.StructField(name, _SPARK_TYPES[tp]) for name, tp in layout(kind)]
    return T.StructType(fields + [T.StructField(STAMP, T.LongType(), False)])
