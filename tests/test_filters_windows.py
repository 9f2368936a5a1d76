import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.filters import (
    drop_headers,
    reject_report,
    rejected_readings,
    stamp_lines,
    valid_readings,
)
from gaugeworks.operators.formatting import (
    format_base,
    format_bme280,
    format_bmp280,
    result_line,
    result_line_with_stamp,
)
from gaugeworks.operators.parsing import parse_base, parse_bme280, parse_bmp280
from gaugeworks.operators.windows import (
    NO_STAMP,
    avg_temperature,
    avg_temperature_max_stamp,
    merge_partials,
    tumbling_avg,
    tumbling_partials,
)

READING = "sensor_id int, timestamp timestamp, temperature double, datagen_ts bigint"


def readings(spark, *rows):
    data = spark.createDataFrame(rows, "sensor_id int, s bigint, temperature double, datagen_ts bigint")
    return data.select("sensor_id", F.timestamp_seconds("s").alias("timestamp"), "temperature", "datagen_ts")


def test_drop_headers(frame):
    kept = drop_headers(frame("sensor_id;x", "1;a", "sensor_identity", " sensor_id", ""))
    assert [r.value for r in kept.collect()] == ["1;a", " sensor_id", ""]


def test_nan_is_valid_null_is_not(spark):
    rows = readings(spark, (1, 0, math.nan, 0), (1, 0, None, 0), (None, 0, 1.0, 0), (2, 0, 3.0, 0))
    assert sorted(r.sensor_id for r in valid_readings(rows).collect()) == [1, 2]


def test_rejects(spark):
    rows = readings(spark, (None, None, None, 0), (1, None, 2.0, 0), (1, 5, 2.0, 0))
    got = sorted(r.reasons for r in rejected_readings(rows).collect())
    assert got == [["no_sensor_id", "no_timestamp", "no_temperature"], ["no_timestamp"]]
    report = {r.reason: r["count"] for r in reject_report(rows).collect()}
    assert report == {"no_sensor_id": 1, "no_timestamp": 2, "no_temperature": 1}


def test_stamp_lines(spark, frame):
    stamped = stamp_lines(frame("a;b").withColumn("at", F.timestamp_millis(F.lit(1500))), "at")
    assert stamped.first().value == "a;b,1500"
    now = parse_base(stamp_lines(frame("1;a"))).first().datagen_ts
    assert now > 1_700_000_000_000


@pytest.mark.parametrize(
    "values,mean", [((10.0, 20.0), 15.0), ((None, 5.0), 5.0), ((None,), math.nan), ((), math.nan)]
)
def test_average(spark, values, mean):
    got = avg_temperature(readings(spark, *[(1, 0, v, 0) for v in values])).first().avg_temp
    assert got == mean or (math.isnan(mean) and math.isnan(got))


def test_newest_stamp_counts_only_rows_with_temperature(spark):
    rows = readings(spark, (1, 0, 1.0, 5), (1, 0, None, 99), (2, 0, None, 7))
    got = {r.sensor_id: r for r in avg_temperature_max_stamp(rows, ["sensor_id"]).collect()}
    assert got[1].max_stamp == 5
    assert got[2].max_stamp == NO_STAMP and math.isnan(got[2].avg_temp)


def test_windows_are_aligned_and_half_open(spark):
    rows = readings(spark, (1, 59, 1.0, 1), (1, 60, 3.0, 2), (1, 119, 5.0, 9), (1, -1, 7.0, 3))
    got = sorted((r.window_start_ms, r.window_end_ms, r.avg_temp, r.max_stamp) for r in tumbling_avg(rows).collect())
    assert got == [(-60000, 0, 7.0, 3), (0, 60000, 1.0, 1), (60000, 120000, 4.0, 9)]


def test_partials_roll_up_to_the_direct_result(spark):
    rows = readings(spark, *[(i % 3, i * 977, None if i % 7 == 0 else i / 4, i) for i in range(500)])
    direct = sorted(map(tuple, tumbling_avg(rows, "1 day").collect()))
    rolled = sorted(map(tuple, merge_partials(tumbling_partials(rows, "1 hour"), "1 day").collect()))
    assert rolled == direct


def results(spark, avg):
    return spark.createDataFrame(
        [(42, 1000, 2000, avg, 17)],
        "sensor_id int, window_start_ms bigint, window_end_ms bigint, avg_temp double, max_stamp bigint",
    )


@pytest.mark.parametrize("avg,text", [(12.345, "12.345"), (1.0005, "1.001"), (2.0, "2.000"), (math.nan, "NaN")])
def test_result_line(spark, avg, text):
    line = f"sensor=42 window=[1000,2000) avg={text}"
    assert result_line(results(spark, avg)).first().line == line
    assert result_line_with_stamp(results(spark, avg)).first().line == line + ",17"


def test_formats(frame):
    line = "7;BME280;3;1.5;-2.25;2020-01-01T10:00:00;1000.0;150.0;1013.25;20.25;55.5,99"
    empty = ";;;;;"
    assert format_base(parse_base(frame(line))).first().line == "7;BME280;3;1.5;-2.25;2020-01-01T10:00:00Z;99"
    assert format_base(parse_base(frame(empty))).first().line == "null;null;null;null;null;null;0"
    assert format_bmp280(parse_bmp280(frame(line))).first().line == (
        "7;BME280;3;1.5;-2.25;2020-01-01T10:00:00Z;1000.0;150.0;1013.25;20.25"
    )
    assert format_bmp280(parse_bmp280(frame(empty))).first().line == ";".join(["null"] * 10)
    assert format_bme280(parse_bme280(frame(line))).first().line == (
        "7,BME280,3,1.5,-2.25,2020-01-01T10:00:00Z,1000.0,150.0,1013.25,20.25,55.5"
    )
    # A missing sensor id prints as a word, everything else as nothing.
    assert format_bme280(parse_bme280(frame(empty))).first().line == "null" + "," * 10


def test_printed_times_are_refused_by_the_parser(frame):
    printed = format_base(parse_base(frame("1;a;2;3;4;2020-01-01T10:00:00"))).select(F.col("line").alias("value"))
    assert parse_base(printed).first().timestamp is None


def test_instant_text(spark):
    from gaugeworks.functions.text import instant_text

    cases = {0: "1970-01-01T00:00:00Z", -1: "1969-12-31T23:59:59.999999Z", 1_500_000: "1970-01-01T00:00:01.500Z"}
    rows = spark.createDataFrame([(k,) for k in cases], "us bigint")
    got = rows.select("us", instant_text(F.timestamp_micros("us")).alias("t")).collect()
    assert {r.us: r.t for r in got} == cases
