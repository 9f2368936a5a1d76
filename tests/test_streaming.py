import os

import pytest

from gaugeworks.plans.jobs import (
    windowed_temperature,
    windowed_temperature_file,
    windowed_temperature_stream,
)
from gaugeworks.operators.filters import drop_headers, valid_readings, with_event_time
from gaugeworks.operators.formatting import result_line_with_stamp
from gaugeworks.operators.parsing import parse_readings
from gaugeworks.operators.windows import merge_partials, tumbling_partials
from gaugeworks.sinks.lines import line_sink, print_sink
from gaugeworks.sources.lines import stream_lines
from gaugeworks.streaming.runs import open_rollups, open_windows, run_available


def line(sensor, clock, temperature, stamp=0):
    return f"{sensor};BME280;1;0.0;0.0;2024-01-01T{clock};1.0;1.0;1.0;{temperature};50.0,{stamp}"


def land(folder, name, lines, mtime):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (mtime, mtime))


LATE = [(1, "00:00:01", 10), (1, "00:01:00", 5), (2, "00:01:01", 5), (1, "00:00:30", 99), (2, "00:03:00", 7)]


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    for i, row in enumerate(LATE):
        land(tmp_path / "in", f"f{i}.txt", [line(*row)], 1_700_000_000 + i)
    results = windowed_temperature(stream_lines(spark, str(tmp_path / "in"), max_files=1))
    query = run_available(results, str(tmp_path / "out"), str(tmp_path / "state"))
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    got = spark.read.parquet(str(tmp_path / "out"))
    start = 1704067200000
    rows = sorted((r.window_start_ms - start, r.sensor_id, r.avg_temp) for r in got.collect())
    assert rows == [(0, 1, 10.0), (60000, 1, 5.0), (60000, 2, 5.0)]
    assert dropped == 1


def test_stream_with_its_open_windows_equals_file_job(spark, tmp_path):
    rows = [line(i % 3, f"0{i // 60}:{i % 60:02d}:{i * 7 % 60:02d}", i / 8, i) for i in range(180)]
    rows[5:5] = ["sensor_id;header"]
    rows[50] = line("x", "00:50:00", 1)
    rows[70] = line(1, "01:10:00", "")
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for part in range(3):
        land(tmp_path / "in", f"f{part}.txt", rows[part * 60 : part * 60 + 61], 1_700_000_000 + part)
        query = windowed_temperature_stream(
            stream_lines(spark, source), sink, state, availableNow=True
        )
        query.awaitTermination()
    closing = result_line_with_stamp(open_windows(spark, state)).select("line")
    written = spark.read.text(sink)
    before = written.count()
    batch_input = str(tmp_path / "copy.txt")
    (tmp_path / "copy.txt").write_text(
        "".join((tmp_path / "in" / f"f{part}.txt").read_text() for part in range(3))
    )
    wanted = sorted(r.line for r in windowed_temperature_file(spark, batch_input).collect())
    got = sorted(r[0] for r in written.union(closing).collect())
    assert got == wanted
    assert before < len(got)
    assert all(text.startswith("sensor=") for text in got)


def test_a_stream_goes_on_after_its_open_windows_were_read(spark, tmp_path):
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    land(tmp_path / "in", "a.txt", [line(1, "00:00:01", 10), line(1, "00:01:00", 5)], 1_700_000_000)
    run = lambda: run_available(windowed_temperature(stream_lines(spark, source)), sink, state)
    run()
    first = [(r.window_start_ms, r.avg_temp) for r in open_windows(spark, state).collect()]
    land(tmp_path / "in", "b.txt", [line(1, "00:01:30", 7), line(1, "00:05:00", 1)], 1_700_000_001)
    run()
    start = 1704067200000
    assert first == [(start + 60_000, 5.0)]
    got = sorted((r.window_start_ms - start, r.avg_temp) for r in spark.read.parquet(sink).collect())
    assert got == [(0, 10.0), (60_000, 6.0)]
    assert [r.window_start_ms - start for r in open_windows(spark, state).collect()] == [300_000]
    both = windowed_temperature_file(spark, source)
    assert both.count() == 3 and both.filter("sensor_id = 0").isEmpty()


def test_rollup_on_a_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    rows = [f"{1 + k % 2};BME280;1;0.0;0.0;2024-01-{1 + k // 30:02d}T{k % 24:02d}:10:00;1.0;1.0;1.0;{k};50.0,{k}" for k in range(100)]
    rows.sort(key=lambda text: text.split(";")[5])

    def days(lines):
        readings = with_event_time(valid_readings(parse_readings(drop_headers(lines), "bme280")))
        return merge_partials(tumbling_partials(readings, "1 hour"), "1 day")

    for part in range(2):
        land(tmp_path / "in", f"f{part}.txt", rows[part * 50 : part * 50 + 50], 1_700_000_000 + part)
        run_available(days(stream_lines(spark, source)), sink, state)
    wanted = sorted(map(tuple, days(spark.read.text(source)).collect()))
    closed = sorted(map(tuple, spark.read.parquet(sink).collect()))
    assert 0 < len(closed) < len(wanted)
    assert sorted(closed + [tuple(r) for r in open_rollups(spark, state, "1 day").collect()]) == wanted


def test_coarse_windows_must_be_multiples(spark):
    readings = spark.sql("SELECT 1 sensor_id, 2.0D temperature, timestamp'2024-01-01 01:50:00' timestamp, 0L datagen_ts")
    with pytest.raises(Exception, match="not a multiple"):
        merge_partials(tumbling_partials(readings, "1 hour"), "90 minutes").collect()


def test_rejects_are_observed(spark, tmp_path):
    rows = [line(1, "00:00:01", 1), line("x", "00:00:02", 1), line(1, "00:00:03", ""), line(1, "bad", 1), "sensor_id;h"]
    land(tmp_path / "in", "a.txt", rows, 1_700_000_000)
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    query = windowed_temperature_stream(stream_lines(spark, source), sink, state, availableNow=True)
    query.awaitTermination()
    seen = [p["observedMetrics"]["rejects"] for p in query.recentProgress if p["numInputRows"]]
    assert [(r["rows"], r["no_sensor_id"], r["no_timestamp"], r["no_temperature"]) for r in seen] == [(4, 1, 1, 1)]


def test_line_sink_on_tables(spark, tmp_path):
    results = spark.createDataFrame([("a",), ("b",)], "line string")
    out = str(tmp_path / "out")
    line_sink(results, out)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        line_sink(results, out)
    line_sink(results, out, mode="ignore")
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a", "b"]
    line_sink(results, str(tmp_path / "json"), fmt="json", options={"compression": "gzip"})
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_every_row_is_printed(spark, tmp_path):
    """More rows than a preview would show, on a table and on a stream."""
    caught = tmp_path / "caught"
    caught.mkdir()

    def emit(text, folder=str(caught)):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(text)

    print_sink(spark.range(57).selectExpr("concat('row ', id) AS line"), emit)
    assert sorted(p.read_text() for p in caught.iterdir()) == sorted(f"row {k}" for k in range(57))
    land(tmp_path / "in", "f.txt", [f"line {k}" for k in range(45)], 1_700_000_000)
    query = print_sink(stream_lines(spark, str(tmp_path / "in")).selectExpr("value AS line"), emit)
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None
    assert len(list(caught.iterdir())) == 57 + 45


def test_other_stream_formats_plug_in(spark):
    stream = stream_lines(spark, fmt="rate", rowsPerSecond="1")
    assert stream.isStreaming and stream.dtypes == [("value", "string")]
    assert windowed_temperature(stream).isStreaming
