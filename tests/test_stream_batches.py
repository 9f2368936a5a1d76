"""Batches, summaries, upserts, counts and latency of streams, held against tables."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.batching import batch_event_time, count_batches, read_batches
from gaugeworks.operators.filters import drop_headers, reject_report
from gaugeworks.operators.latency import latency_summary, parse_latency
from gaugeworks.operators.parsing import parse_readings
from gaugeworks.operators.scans import number_rows
from gaugeworks.operators.windows import avg_temperature
from gaugeworks.plans.jobs import windowed_temperature
from gaugeworks.sources.lines import stream_lines
from gaugeworks.streaming.batches import _cut, batches_stream, last_batch, read_batches_stream
from gaugeworks.streaming.latency import match_arrivals, open_results
from gaugeworks.streaming.progress import progress_log, progress_table, stream_reject_report
from gaugeworks.streaming.runs import run_available
from gaugeworks.streaming.summaries import (
    averages_so_far,
    latency_so_far,
    running_averages,
    running_latency,
)
from gaugeworks.streaming.upserts import read_upserts, upsert_sink, upsert_step
from test_streaming import LATE, land, line


def batch_lines(count, seed=1):
    rng = random.Random(seed)
    return [f"1;x;1;0;0;2024-01-01T0{rng.randrange(10)}:00:{k % 60:02d};{k}" for k in range(count)]


def as_tuples(batches):
    rows = batches.select("batch_id", "is_last", "event_ts", "arrival_ts", "measurements").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


@pytest.mark.parametrize("files", [[8, 0, 3, 30, 2], [7, 7], [0, 0]])
def test_batches_do_not_depend_on_the_cut(spark, tmp_path, files):
    """Files of any sizes, a header each, one or more per micro-batch, with a restart for each run."""
    source, sink, held, state = (str(tmp_path / name) for name in ("in", "out", "held", "state"))
    rows = batch_lines(sum(files))
    at = 0
    for number, count in enumerate(files):
        land(tmp_path / "in", f"f{number}.txt", ["header", *rows[at : at + count]], 1_700_000_000 + number)
        at += count
        if number % 2 or number == len(files) - 1:
            stream = stream_lines(spark, source, max_files=1)
            batches_stream(stream, sink, held, state, 7, availableNow=True).awaitTermination()
    wanted = as_tuples(batch_event_time(read_batches(spark, source, 7)))
    got = read_batches_stream(spark, sink, held)
    assert (as_tuples(got) if got is not None else []) == wanted
    kept = spark.read.parquet(f"{held}/{max(int(p.name) for p in (tmp_path / 'held').iterdir())}")
    assert kept.filter("value is not null").count() <= 7


def test_batches_of_a_stream_with_its_own_order(spark, tmp_path):
    source, sink, held, state = (str(tmp_path / name) for name in ("in", "out", "held", "state"))
    rows = list(enumerate(batch_lines(40), start=100))
    frame = spark.createDataFrame(rows, "ord bigint, value string")
    for low, high in ((100, 113), (113, 114), (114, 140)):
        part = frame.filter((F.col("ord") >= low) & (F.col("ord") < high))
        part.repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        batches_stream(stream, sink, held, state, 5, "ord", availableNow=True).awaitTermination()
    wanted = as_tuples(batch_event_time(count_batches(number_rows(frame, "ord"), 5)))
    assert as_tuples(read_batches_stream(spark, sink, held)) == wanted
    open_ended = read_batches_stream(spark, sink, held, ended=False)
    assert open_ended.count() == 7 and last_batch(spark, held).count() == 1


def test_a_repeated_micro_batch_adds_no_batch(spark):
    lines = number_rows(spark.createDataFrame(list(enumerate(batch_lines(23))), "ord bigint, value string"), "ord")
    first, held = _cut(lines, None, 5)
    again, held_again = _cut(lines, None, 5)
    assert as_tuples(first) == as_tuples(again) and first.count() == 4
    assert sorted(map(tuple, held.collect()), key=repr) == sorted(map(tuple, held_again.collect()), key=repr)


def readings_rows(count):
    rng = random.Random(count)
    rows = [line(k % 5, f"0{k // 60 % 10}:{k % 60:02d}:00", rng.choice(["", 1.5, k / 4]), k) for k in range(count)]
    return ["sensor_id;header", *rows, line("x", "00:00:00", 3), line(2, "bad", 4)]


def test_running_averages_equal_the_table(spark, tmp_path):
    source, parts, state = (str(tmp_path / name) for name in ("in", "parts", "state"))
    rows = readings_rows(120)
    assert averages_so_far(spark, parts) is None
    for step in range(3):
        land(tmp_path / "in", f"f{step}.txt", rows[step * 40 : step * 40 + 40], 1_700_000_000 + step)
        readings = parse_readings(drop_headers(stream_lines(spark, source)), "bme280")
        running_averages(readings, parts, state, availableNow=True).awaitTermination()
    table = parse_readings(drop_headers(spark.read.text(source)), "bme280")
    near = lambda rows: sorted((str(r.sensor_id), str(round(r.avg_temp, 6))) for r in rows.collect())
    assert near(averages_so_far(spark, parts)) == near(avg_temperature(table, ["sensor_id"]))


def test_running_latency_equals_the_table(spark, tmp_path):
    source, parts, state = (str(tmp_path / name) for name in ("in", "parts", "state"))
    rows = [f"{k * 7 % 50},res,{k},{k + 9}" for k in range(40)] + ["", "a,b", "x,r,1,2"]
    for step, chosen in enumerate((rows[40:], rows[:15], rows[15:40])):
        land(tmp_path / "in", f"f{step}.txt", chosen, 1_700_000_000 + step)
        parsed = parse_latency(stream_lines(spark, source))
        running_latency(parsed, parts, state, availableNow=True).awaitTermination()
        wanted = latency_summary(parse_latency(spark.read.text(source))).collect()
        assert latency_so_far(spark, parts).collect() == wanted
    assert wanted[0].tuples == 40


KEYS = ("sensor_id", "window_start_ms", "window_end_ms")


def test_open_windows_are_seen_while_the_stream_runs(spark, tmp_path):
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    seen = []
    for number, row in enumerate([LATE[0], (1, "00:00:40", 20), *LATE[1:3], LATE[4]]):
        land(tmp_path / "in", f"f{number}.txt", [line(*row)], 1_700_000_000 + number)
        results = windowed_temperature(stream_lines(spark, source))
        upsert_sink(results, sink, state, merge_every=2, availableNow=True).awaitTermination()
        start = 1704067200000
        rows = read_upserts(spark, sink).collect()
        seen.append(sorted((r.sensor_id, (r.window_start_ms - start) // 60000, r.avg_temp) for r in rows))
    assert seen[0] == [(1, 0, 10.0)] and seen[1] == [(1, 0, 15.0)]  # replaced while it is open
    whole = windowed_temperature(spark.read.text(source))
    assert sorted(map(tuple, read_upserts(spark, sink).collect())) == sorted(map(tuple, whole.collect()))


def test_a_killed_and_repeated_micro_batch_leaves_the_same_rows(spark, tmp_path):
    """The stream dies behind its write, so the same micro-batch comes again after the restart."""
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    failures = []

    def run():
        results = windowed_temperature(stream_lines(spark, source))

        def step(rows, number):
            upsert_step(rows, number, sink, KEYS, 2)
            if not failures and not rows.filter("avg_temp = 20").isEmpty():
                failures.append(number)
                raise RuntimeError("killed behind the write")

        writer = results.writeStream.foreachBatch(step).outputMode("update")
        query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    land(tmp_path / "in", "a.txt", [line(1, "00:00:01", 10), line(2, "00:00:02", 1)], 1_700_000_000)
    run()
    land(tmp_path / "in", "b.txt", [line(1, "00:00:30", 30)], 1_700_000_001)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    whole = windowed_temperature(spark.read.text(source))
    assert failures and sorted(map(tuple, read_upserts(spark, sink).collect())) == sorted(map(tuple, whole.collect()))


def test_a_half_written_step_or_base_is_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda value: spark.createDataFrame([(1, value)], "k int, v int")
    for number in range(7):
        upsert_step(frame(number), number, path, ["k"], 3)
        upsert_step(frame(number), number, path, ["k"], 3)  # again
        assert [tuple(r) for r in read_upserts(spark, path, ["k"]).collect()] == [(1, number)]
    for name in ("step=7", "base=9"):
        (tmp_path / "out" / name).mkdir()
        (tmp_path / "out" / name / "part-0.parquet").write_bytes(b"half")
    assert [tuple(r) for r in read_upserts(spark, path, ["k"]).collect()] == [(1, 6)]
    assert len(list((tmp_path / "out").glob("step=*"))) <= 7  # merged ones are gone
    with pytest.raises(ValueError):
        upsert_sink(frame(1), path, "x", mode="append")


def test_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    source, sink, state, counts = (str(tmp_path / name) for name in ("in", "out", "state", "counts"))
    assert progress_table(spark, counts).count() == 0
    rows = readings_rows(60)
    with progress_log(spark, counts):
        for step in range(3):
            land(tmp_path / "in", f"f{step}.txt", rows[step * 21 : step * 21 + 21], 1_700_000_000 + step)
            run_available(windowed_temperature(stream_lines(spark, source)), sink, state)
        for number, row in enumerate(LATE):
            land(tmp_path / "late", f"f{number}.txt", [line(*row)], 1_700_000_000 + number)
        late = stream_lines(spark, str(tmp_path / "late"), max_files=1)
        query = run_available(windowed_temperature(late), str(tmp_path / "o2"), str(tmp_path / "s2"))
    table = parse_readings(drop_headers(spark.read.text(source)), "bme280")
    wanted = sorted(map(tuple, reject_report(table).collect()))
    assert sorted(map(tuple, stream_reject_report(spark, counts).collect())) == wanted and len(wanted) == 3
    rows = progress_table(spark, counts)
    assert rows.filter(F.col("query") == str(query.id)).agg(F.sum("dropped_late")).first()[0] == 1
    assert rows.select("query", "batch_id").distinct().count() == rows.count()


HOUR = 3_600_000
RESULTS = "sensor_id int, window_start_ms bigint, max_stamp bigint"
ARRIVALS = "sensor_id int, window_start_ms bigint, ingestion_ts_ms bigint"


def frames(spark, step):
    base = step * 10 * HOUR + HOUR
    results = [(k, base + k, base + 60_000 * k) for k in range(6)]
    came = [(0, base, base), (1, base + 1, base + 60_000 + HOUR), (2, base + 2, base + 120_001 + HOUR)]
    came += [(3, base + 3, base + 180_000 - 1), (4, base + 4, base + 250_000), (4, base + 4, base + 260_000)]
    came += [(77, base, base + 5)]  # of no result
    return spark.createDataFrame(results, RESULTS), spark.createDataFrame(came, ARRIVALS)


def matched(rows):
    return sorted(((r.sensor_id, r.event_ts_ms, r.ingestion_ts_ms, r.latency_ms) for r in rows.collect()), key=repr)


def test_results_meet_arrivals_within_the_interval(spark):
    got = matched(match_arrivals(*frames(spark, 0)))
    latencies = [(sensor, latency) for sensor, _, _, latency in got]
    assert sorted(latencies, key=repr) == sorted(
        [(0, 0), (1, HOUR), (2, None), (3, None), (4, 10_000), (4, 20_000), (5, None)], key=repr
    )


def test_matching_streams_equals_matching_tables(spark, tmp_path):
    folders = [str(tmp_path / name) for name in ("results", "arrivals")]
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    for step in range(3):
        streams = []
        for table, folder in zip(frames(spark, step), folders):
            table.write.mode("append").parquet(folder)
            streams.append(spark.readStream.schema(table.schema).parquet(folder))
        run_available(match_arrivals(*streams), sink, state)
    written = spark.read.parquet(sink)
    waiting = open_results(spark, state, written)
    tables = [spark.read.parquet(folder) for folder in folders]
    wanted = matched(match_arrivals(*tables))
    assert matched(written.unionByName(waiting)) == wanted
    # Unmatched results of earlier steps were given as soon as their interval had passed.
    assert written.filter("latency_ms is null").count() >= 3 and waiting.count() <= 3
