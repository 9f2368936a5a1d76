"""Sensor lines derived from the ``events`` table, with known defects.

Each event becomes one line of the asked kind, followed by its generator stamp. Defects follow
from the event id, so that SQL can tell which rows carry them: every 17th has no main value, every
23rd an unreadable sensor id, every 29th an unreadable time, and a header line precedes every
1000th. A row may carry several. All events are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.functions.text import second_text
from gaugeworks.schemas import METRIC_FIELDS, layout

NO_VALUE_EVERY = 17
BAD_SENSOR_EVERY = 23
BAD_TIME_EVERY = 29
HEADER_EVERY = 1000


def load_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The events table with ``ts`` as an instant; the stored one is UTC without a zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(*columns) if columns else events


def _every(divisor: int) -> Column:
    return F.col("event_id") % divisor == 0


def _metric_texts(kind: str) -> list[Column]:
    main = F.when(_every(NO_VALUE_EVERY), F.lit("")).otherwise(F.col("value").cast("string"))
    second = F.col("event_id") % 100 + F.lit(0.5)
    texts = {
        "p1": main,
        "p2": second,
        "p0": F.lit("9.60"),
        "pressure": F.lit(1000.0) + F.col("value") / 10.0,
        "altitude": F.lit("150.0"),
        "pressure_at_sea_level": F.lit("1013.25"),
        "temperature": main,
        "humidity": second,
    }
    return [texts[name].cast("string") for name in METRIC_FIELDS[kind]]


def line_text(kind: str, stamped: bool = True) -> Column:
    """The line of an event as text."""
    user = F.col("user_id")
    time = second_text(F.col("ts"))
    line = F.concat_ws(
        ";",
        F.when(_every(BAD_SENSOR_EVERY), F.lit("x")).otherwise(user.cast("string")),
        F.lit(kind.upper()),
        (user % 25).cast("string"),
        (F.lit(50.0) + user / 1000.0).cast("string"),
        (F.lit(20.0) + user / 1000.0).cast("string"),
        F.when(_every(BAD_TIME_EVERY), F.lit("bad")).otherwise(time),
        *_metric_texts(kind),
    )
    return F.concat_ws(",", line, F.unix_millis("ts").cast("string")) if stamped else line


def header_text(kind: str) -> str:
    return ";".join(name for name, _ in layout(kind))


def event_lines(events: DataFrame, kind: str, stamped: bool = True) -> DataFrame:
    """Lines with headers: ``ord`` (unique, file order), ``event_id``, ``ts`` and ``value``."""

    def entry(after: int, text: Column) -> Column:
        return F.struct((F.col("event_id") * 2 + after).alias("ord"), text.alias("value"))

    # Plain arrays of a ready text: array functions with lambdas would leave generated code.
    line = entry(1, F.col("text"))
    header = entry(0, F.lit(header_text(kind)))
    entries = F.when(_every(HEADER_EVERY), F.array(header, line)).otherwise(F.array(line))
    texts = events.select("event_id", "ts", line_text(kind, stamped).alias("text"))
    return texts.select("event_id", "ts", F.explode(entries).alias("e")).select(
        "e.ord", "event_id", "ts", "e.value"
    )
