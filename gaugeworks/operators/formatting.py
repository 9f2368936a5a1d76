"""Readings and window results as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.functions.text import instant_text, text_or
from gaugeworks.schemas import STAMP, layout

# Output formats.
RESULT_FORMAT = "sensor=%d window=[%d,%d) avg=%.3f"
RESULT_WITH_STAMP = r"^(sensor=-?\d+ window=\[-?\d+,-?\d+\) avg=[^,]+),(-?\d+)$"
NULL_WORD = "null"
# End of fixed values.


def result_line(results: DataFrame) -> DataFrame:
    """Add ``line``: key, window bounds and average of a window result."""
    line = F.format_string(
        RESULT_FORMAT, "sensor_id", "window_start_ms", "window_end_ms", "avg_temp"
    )
    return results.withColumn("line", line)


def result_line_with_stamp(results: DataFrame) -> DataFrame:
    """As ``result_line``, with the newest stamp after a comma. Sinks add the newline."""
    lined = result_line(results)
    return lined.withColumn("line", F.concat_ws(",", "line", "max_stamp"))


def _texts(readings: DataFrame, names: list[str], null_text: dict[str, str], default: str):
    columns = []
    for name in names:
        column = F.col(name)
        if name == "timestamp":
            column = instant_text(column)
        columns.append(text_or(column, null_text.get(name, default)))
    return columns


def format_base(readings: DataFrame) -> DataFrame:
    """Add ``line``: the base fields and the stamp; missing values print as a word."""
    names = [name for name, _ in layout("base")] + [STAMP]
    return readings.withColumn("line", F.concat_ws(";", *_texts(readings, names, {}, NULL_WORD)))


def format_bmp280(readings: DataFrame) -> DataFrame:
    """Add ``line``: the ten BMP280 fields without the stamp; missing values print as a word."""
    names = [name for name, _ in layout("bmp280")]
    return readings.withColumn("line", F.concat_ws(";", *_texts(readings, names, {}, NULL_WORD)))


def format_bme280(readings: DataFrame) -> DataFrame:
    """Add ``line``: the eleven BME280 fields; missing values are empty, a missing id is a word."""
    names = [name for name, _ in layout("bme280")]
    texts = _texts(readings, names, {"sensor_id": NULL_WORD}, "")
    return readings.withColumn("line", F.concat_ws(",", *texts))
