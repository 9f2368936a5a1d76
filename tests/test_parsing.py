import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.fields import READERS
from gaugeworks.operators.parsing import (
    parse_base,
    parse_bme280,
    parse_bmp280,
    parse_pms7003,
)
from gaugeworks.schemas import reading_schema

BASE = "21358;TYPE;13506;50.852;20.632;2020-01-01T00:00:01"
T = datetime(2020, 1, 1, 0, 0, 1)


def one(readings):
    return readings.collect()[0].asDict()


def test_base_line(frame):
    row = one(parse_base(frame(BASE)))
    assert row == {
        "sensor_id": 21358, "sensor_type": "TYPE", "location": 13506, "lat": 50.852,
        "lon": 20.632, "timestamp": T, "datagen_ts": 0,
    }


def test_pms7003_line_with_newline(frame):
    row = one(parse_pms7003(frame(BASE.replace("TYPE", "PMS7003") + ";20.20;17.80;9.60\n")))
    assert (row["p1"], row["p2"], row["p0"]) == (20.2, 17.8, 9.6)
    assert (row["sensor_id"], row["timestamp"]) == (21358, T)


def test_bmp280_and_bme280_line(frame):
    line = BASE + ";1013.25;150.0;1000.0;20.20"
    row = one(parse_bmp280(frame(line)))
    assert (row["pressure"], row["altitude"]) == (1013.25, 150.0)
    assert (row["pressure_at_sea_level"], row["temperature"]) == (1000.0, 20.2)
    assert one(parse_bme280(frame(line + ";55.5")))["humidity"] == 55.5


@pytest.mark.parametrize("parse", [parse_base, parse_pms7003, parse_bmp280, parse_bme280])
@pytest.mark.parametrize("line", [";;;;;;", ";;;;;", "", ",;,"])
def test_empty_fields_give_nulls(frame, parse, line):
    row = one(parse(frame(line)))
    assert row.pop("datagen_ts") == 0
    assert set(row.values()) == {None}


def test_either_separator_and_stamp(frame):
    row = one(parse_pms7003(frame(BASE.replace(";", ",") + ",1.5,2.5,3.5,1780849502772")))
    assert (row["p1"], row["p0"], row["datagen_ts"]) == (1.5, 3.5, 1780849502772)
    # An unstamped line whose last field is a whole number takes it as stamp.
    assert one(parse_pms7003(frame(BASE + ";1;2;55;;;")))["datagen_ts"] == 55


@pytest.mark.parametrize("kind", ["base", "pms7003", "bmp280", "bme280"])
def test_schema_matches_layout(frame, kind):
    from gaugeworks.operators.parsing import parse_readings

    got = [(f.name, f.dataType) for f in parse_readings(frame(BASE), kind).schema]
    assert got == [(f.name, f.dataType) for f in reading_schema(kind)]
    with pytest.raises(ValueError):
        reading_schema("other")


def test_chosen_columns_only(frame):
    from gaugeworks.operators.parsing import parse_readings

    some = parse_readings(frame(BASE), "bme280", columns=["timestamp", "sensor_id"])
    assert some.columns == ["sensor_id", "timestamp"]
    assert tuple(some.first()) == (21358, T)
    with pytest.raises(ValueError):
        parse_readings(frame(BASE), "base", columns=["humidity"])


# What the line format accepts, as a plain model.


def model_int(text, bits=32):
    import re

    if not re.fullmatch(r"[+-]?[0-9]+", text):
        return None
    number = int(text)
    return number if -(2 ** (bits - 1)) <= number < 2 ** (bits - 1) else None


def model_double(text):
    import re

    text = text.strip("".join(map(chr, range(33))))
    if re.fullmatch(r"[+-]?(NaN|Infinity)", text):
        return float(text)
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?", text):
        return float(text.rstrip("dDfF"))
    return None


def model_time(text):
    import re

    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)", text, re.ASCII)
    if not m:
        return None
    year, month, day, hour, minute, second = map(int, m.groups())
    if not (1 <= year and 1 <= month <= 12 and 1 <= day <= 31 and minute < 60 and second < 60):
        return None
    if hour > 24 or (hour == 24 and (minute or second)):
        return None
    next_month = datetime(year + month // 12, month % 12 + 1, 1)
    date = min(datetime(year, month, 1) + timedelta(days=day - 1), next_month - timedelta(days=1))
    return date + timedelta(hours=hour, minutes=minute, seconds=second)


PIECES = ["0", "7", "12", "2147483647", "2147483648", "9223372036854775808", "+5", "-5", "5.", ".5",
          "5.7", "1e3", "1d", "2f", "NaN", "nan", "Infinity", "-Infinity", "inf", "-inf", "Inf",
          "+NaN", " 5", "5 ", "\t7", "x", "", "-", "1_0", "１"]
TIMES = ["2020-01-01T00:00:01", "2020-02-30T10:00:00", "2021-02-29T24:00:00", "2020-04-31T23:59:59",
         "2020-13-01T00:00:00", "2020-01-32T00:00:00", "2020-01-00T00:00:00", "2020-01-01T24:00:00",
         "2020-01-01T24:00:01", "2020-01-01T25:00:00", "2020-01-01T00:60:00", "2020-01-01 00:00:00",
         "2020-01-01T00:00:00Z", "2020-1-01T00:00:000", "0000-01-01T00:00:00", "2020-01-01T00:00:1.",
         "2020-01-01T00:00:1 ", "bad", "", "12020-1-01T00:00:00", "2020-01-01"]


def test_values_follow_the_model(spark):
    rng = random.Random(3)
    texts = PIECES + TIMES + ["".join(rng.choices("0159+-.eE nNaIfd", k=rng.randint(1, 6))) for _ in range(800)]
    # Hexadecimal floats are outside the model, and plain digits never clash with it.
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        READERS["int"](F.col("t")).alias("i"),
        READERS["double"](F.col("t")).alias("d"),
        READERS["timestamp"](F.col("t")).alias("ts"),
    )
    for row in rows.collect():
        assert row.i == model_int(row.t), row
        wanted = model_double(row.t)
        assert (row.d == wanted) or (wanted is not None and math.isnan(wanted) and math.isnan(row.d)), row
        assert row.ts == model_time(row.t), row


def test_times_do_not_depend_on_session_zone(spark, frame):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        lines = frame(BASE, BASE.replace("01-01T00:00:01", "02-30T24:00:00"))
        got = [r[0] for r in parse_base(lines).select(F.unix_millis("timestamp")).collect()]
        assert got == [1577836801000, 1583020800000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_readers_do_not_raise_without_ansi(spark, frame):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        row = one(parse_bme280(frame("99999999999;;x;inf;1e3;2020-02-30T00:00:00")))
        assert (row["sensor_id"], row["lat"], row["lon"]) == (None, None, 1000.0)
        assert row["timestamp"] == datetime(2020, 2, 29)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
