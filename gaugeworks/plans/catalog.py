"""Queries over the test tables, one or more per operator.

All read the whole ``events`` table, as sensor lines (see ``event_lines``). Window bounds are
epoch ms and averages are rounded, so that results compare exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.operators import batching, filters, formatting, latency, trailing, windows
from gaugeworks.operators.parsing import parse_readings
from gaugeworks.operators.scans import number_rows
from gaugeworks.plans import jobs
from gaugeworks.schemas import STAMP, layout
from gaugeworks.session import forget, rocksdb_state, scratch_path, settle
from gaugeworks.sinks.lines import line_sink, print_sink
from gaugeworks.sinks.published import read_published, use_published
from gaugeworks.sources.event_lines import event_lines, header_text, line_text, load_events
from gaugeworks.sources.growing import growing_lines, open_folder
from gaugeworks.sources.lines import stream_lines
from gaugeworks.streaming.batches import batches_stream, read_batches_stream
from gaugeworks.streaming.latency import match_arrivals, open_results
from gaugeworks.streaming.progress import progress_log, stream_reject_report
from gaugeworks.streaming.runs import open_rollups, open_windows, run_available
from gaugeworks.streaming.summaries import (
    averages_so_far,
    latency_so_far,
    running_averages,
    running_latency,
)
from gaugeworks.streaming.trailing import trailing_bounds_stream, trailing_windows_stream
from gaugeworks.streaming.upserts import read_upserts, upsert_sink

Query = Callable[[SparkSession, str], DataFrame]

TRAILING_SIZE = 20  # lines per batch in the trailing queries
TRAILING_KEYS = 3
WATERMARK_PARTS = 8  # micro-batches of the trailing windows by the engine's watermark
WATERMARK_HORIZON_MS = 7 * trailing.DAY_MS


def _lines(spark: SparkSession, sf: str, kind: str, stamped: bool = True) -> DataFrame:
    return event_lines(load_events(spark, sf), kind, stamped)


def _readings(spark: SparkSession, sf: str, kind: str = "bme280") -> DataFrame:
    lines = filters.drop_headers(_lines(spark, sf, kind))
    return parse_readings(lines, kind, keep=["event_id"])


def _rounded(results: DataFrame) -> DataFrame:
    return results.withColumn("avg_temp", F.round("avg_temp", 6))


# --- parsing and filters -------------------------------------------------------------------


def parse_kind(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        readings = _readings(spark, sf, kind)
        rest = [name for name, _ in layout(kind) if name != "timestamp"]
        time = F.unix_millis("timestamp").alias("timestamp_ms")
        return readings.select("event_id", *rest, time, STAMP)

    return run


def header_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.drop_headers(_lines(spark, sf, "bme280")).select("ord", "value")


def valid_readings(spark: SparkSession, sf: str) -> DataFrame:
    valid = filters.valid_readings(_readings(spark, sf))
    return valid.select("event_id", "sensor_id", "temperature")


def rejected_readings(spark: SparkSession, sf: str) -> DataFrame:
    rejected = filters.rejected_readings(_readings(spark, sf))
    return rejected.select("event_id", F.array_join("reasons", "+").alias("reasons"))


def reject_report(spark: SparkSession, sf: str) -> DataFrame:
    return filters.reject_report(_readings(spark, sf)).select("reason", F.col("count").alias("n"))


def stamp_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf, "pms7003", stamped=False)
    return filters.stamp_lines(lines, "ts").select("ord", "value")


# --- averages and windows ------------------------------------------------------------------


def tumbling_avg(duration: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(jobs.windowed_temperature(_lines(spark, sf, "bme280"), duration))

    return run


def _with_nan_flag(averages: DataFrame) -> DataFrame:
    """A NaN average as flag and zero: the flag is the finding, and zero compares exactly."""
    absent = F.isnan("avg_temp")
    mean = F.when(absent, F.lit(0.0)).otherwise(F.round("avg_temp", 6))
    return averages.withColumn("is_nan", absent).withColumn("avg_temp", mean)


def avg_empty_nan(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.expr("unix_millis(timestamp) div 60000").alias("minute")
    readings = _readings(spark, sf)
    return _with_nan_flag(windows.avg_temperature(readings, ["sensor_id", minute]))


def avg_max_stamp(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.expr("unix_millis(timestamp) div 60000").alias("minute")
    readings = _readings(spark, sf)
    return _with_nan_flag(windows.avg_temperature_max_stamp(readings, ["sensor_id", minute]))


def rollup_hour_to_day(spark: SparkSession, sf: str) -> DataFrame:
    valid = filters.valid_readings(_readings(spark, sf))
    return _rounded(windows.merge_partials(windows.tumbling_partials(valid, "1 hour"), "1 day"))


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    results = jobs.windowed_temperature(_lines(spark, sf, "bme280"))
    plain = formatting.result_line(results).withColumnRenamed("line", "plain_line")
    both = formatting.result_line_with_stamp(plain)
    return both.select("sensor_id", "window_start_ms", "plain_line", "line")


# --- files and streams ---------------------------------------------------------------------


def write_line_files(spark: SparkSession, sf: str, kind: str) -> str:
    """Write the lines of each day of events to one file, header first, in a fresh folder.

    Events come in order of time, so path order is event order.
    """
    events = load_events(spark, sf)
    folder = scratch_path(spark, f"{kind}-lines")
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    lines = events.select(day, "event_id", line_text(kind).alias("value"))
    headers = events.select(day).distinct().select(
        "day", F.lit(None).cast("bigint").alias("event_id"), F.lit(header_text(kind)).alias("value")
    )
    (
        lines.union(headers)
        .repartition("day")
        .sortWithinPartitions("day", F.asc_nulls_first("event_id"))
        .select("day", "value")
        .write.partitionBy("day")
        .text(folder)
    )
    return folder


def file_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    folder = write_line_files(spark, sf, "bme280")
    results = jobs.windowed_temperature_file(spark, folder)
    return _rounded(results).drop("line")


def _land_in_time_order(spark: SparkSession, lines: DataFrame, folder: str):
    """Write lines in three steps of event time; yields after each step has landed."""
    low, high = lines.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * step / 3 for step in (1, 2)] if low else [None, None]
    step = F.when(F.col("ts") < F.lit(cuts[0]), 0).when(F.col("ts") < F.lit(cuts[1]), 1)
    staged = settle(lines.select("value", step.otherwise(2).alias("step")), "staged")
    for number in range(3):
        landed = staged.filter(F.col("step") == number)
        landed.select("value").write.mode("append").text(folder)
        yield number
    forget(staged)


def stream_tumbling_1d(spark: SparkSession, sf: str) -> DataFrame:
    source, sink, state = (scratch_path(spark, label) for label in ("lines", "days", "state"))
    for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
        results = jobs.windowed_temperature(stream_lines(spark, source), "1 day")
        run_available(results, sink, state)
    return _rounded(spark.read.parquet(sink).unionByName(open_windows(spark, state)))


def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Hours, and days from the hours, in one stream."""
    source, sink, state = (scratch_path(spark, label) for label in ("lines", "days", "state"))
    for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
        readings = parse_readings(filters.drop_headers(stream_lines(spark, source)), "bme280")
        hours = windows.tumbling_partials(
            filters.with_event_time(filters.valid_readings(readings)), "1 hour"
        )
        run_available(windows.merge_partials(hours, "1 day"), sink, state)
    days = spark.read.parquet(sink).unionByName(open_rollups(spark, state, "1 day"))
    return _rounded(days)


def stream_lines_job(spark: SparkSession, sf: str) -> DataFrame:
    source, sink, state = (scratch_path(spark, label) for label in ("lines", "results", "state"))
    for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
        query = jobs.windowed_temperature_stream(
            stream_lines(spark, source), sink, state, availableNow=True
        )
        query.awaitTermination()
    closing = formatting.result_line_with_stamp(open_windows(spark, state))
    return _result_fields(spark.read.text(sink).union(closing.select("line")))


def _result_fields(written: DataFrame) -> DataFrame:
    """Result lines in ``value`` as columns."""
    parts = r"^sensor=(\d+) window=\[(\d+),(\d+)\) avg=([^,]+),(-?\d+)$"
    names = ("sensor_id", "window_start_ms", "window_end_ms", "avg_text", "max_stamp")
    types = ("int", "bigint", "bigint", "string", "bigint")
    return written.select(
        *[
            F.regexp_extract("value", parts, group).cast(tp).alias(name)
            for group, (name, tp) in enumerate(zip(names, types), start=1)
        ]
    )


def stream_growing(spark: SparkSession, sf: str) -> DataFrame:
    """As ``stream_tumbling_1d``, from files that are followed byte by byte."""
    source, sink, state = (scratch_path(spark, label) for label in ("lines", "days", "state"))
    for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
        run_available(jobs.windowed_temperature(growing_lines(spark, source), "1 day"), sink, state)
    return _rounded(spark.read.parquet(sink).unionByName(open_windows(spark, state)))


def stream_published(spark: SparkSession, sf: str) -> DataFrame:
    """Result lines to a target that is not one of Spark's own formats."""
    source, sink, state = (scratch_path(spark, label) for label in ("lines", "target", "state"))
    target = {"fmt": use_published(spark), "options": {"path": sink}}
    for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
        results = formatting.result_line_with_stamp(jobs.windowed_temperature(stream_lines(spark, source)))
        line_sink(results, None, state, **target, availableNow=True).awaitTermination()
    closing = formatting.result_line_with_stamp(open_windows(spark, state))
    line_sink(closing, None, mode="append", **target)
    return _result_fields(read_published(spark, sink).select("value"))


def stream_windows_update(spark: SparkSession, sf: str) -> DataFrame:
    """Days with the open ones, whose rows every micro-batch replaces."""
    source, sink, state = (scratch_path(spark, label) for label in ("lines", "days", "state"))
    for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
        results = jobs.windowed_temperature(stream_lines(spark, source), "1 day")
        upsert_sink(results, sink, state, merge_every=2, availableNow=True).awaitTermination()
    return _rounded(read_upserts(spark, sink))


def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    labels = ("lines", "days", "state", "progress")
    source, sink, state, counts = (scratch_path(spark, label) for label in labels)
    with progress_log(spark, counts):
        for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
            run_available(jobs.windowed_temperature(stream_lines(spark, source), "1 day"), sink, state)
    return stream_reject_report(spark, counts).select("reason", F.col("count").alias("n"))


def stream_averages(spark: SparkSession, sf: str) -> DataFrame:
    """The mean temperature per sensor of all that has come, over three runs."""
    source, parts, state = (scratch_path(spark, label) for label in ("lines", "parts", "state"))
    for _ in _land_in_time_order(spark, _lines(spark, sf, "bme280"), source):
        readings = parse_readings(filters.drop_headers(stream_lines(spark, source)), "bme280")
        running_averages(readings, parts, state, availableNow=True).awaitTermination()
    return _with_nan_flag(averages_so_far(spark, parts))


def printed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What the console sink prints, caught in one file per partition."""
    results = formatting.result_line_with_stamp(jobs.windowed_temperature(_lines(spark, sf, "bme280")))
    folder = scratch_path(spark, "printed")

    def catch(texts) -> None:
        files, place = open_folder(folder)
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/{uuid.uuid4().hex}.txt") as out:
            for text in texts:
                out.write(f"{text}\n".encode())

    print_sink(results, emit_all=catch)
    return spark.read.text(folder).select(F.col("value").alias("line"))


# --- batches -------------------------------------------------------------------------------


def _numbered(spark: SparkSession, sf: str, kind: str = "pms7003") -> DataFrame:
    """Event lines numbered in file order without the very first line."""
    numbered = number_rows(_lines(spark, sf, kind), "ord").filter(F.col("n") > 0)
    return numbered.withColumn("n", F.col("n") - 1).withColumn("total", F.col("total") - 1)


def _batches(spark: SparkSession, sf: str, size: int = batching.BATCH_SIZE) -> DataFrame:
    return batching.count_batches(_numbered(spark, sf), size)


def _joined(measurements: str | Column = "measurements") -> Column:
    return F.array_join(measurements, "|").alias("lines")


def count_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf).select("batch_id", "is_last", _joined())


def file_batches(spark: SparkSession, sf: str) -> DataFrame:
    folder = write_line_files(spark, sf, "pms7003")
    return batching.read_batches(spark, folder).select("batch_id", "is_last", _joined())


def batch_event_time(spark: SparkSession, sf: str) -> DataFrame:
    timed = batching.batch_event_time(_batches(spark, sf))
    return timed.select(
        "batch_id",
        F.unix_millis("event_ts").alias("event_ms"),
        F.unix_millis("arrival_ts").alias("arrival_ms"),
    )


def stream_count_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batches of the line files, which land in three steps that cut batches anywhere."""
    labels = ("files", "batches", "held", "state")
    source, sink, held, state = (scratch_path(spark, label) for label in labels)
    files = spark.read.text(write_line_files(spark, sf, "pms7003"))
    files = files.select("value", F.col("day").cast("string").alias("day"), F.monotonically_increasing_id().alias("at"))
    landing = settle(files, "landing")
    days = [row.day for row in landing.select("day").distinct().orderBy("day").collect()]
    for step in range(3):
        chosen = days[len(days) * step // 3 : len(days) * (step + 1) // 3]
        landed = landing.filter(F.col("day").isin(chosen)).repartition("day")
        landed = landed.sortWithinPartitions("day", "at").select("day", "value")
        landed.write.mode("append").partitionBy("day").text(source)
        batches_stream(
            stream_lines(spark, source), sink, held, state, availableNow=True
        ).awaitTermination()
    batches = read_batches_stream(spark, sink, held)
    return batches.select(
        "batch_id",
        "is_last",
        _joined(),
        F.unix_millis("event_ts").alias("event_ms"),
        F.unix_millis("arrival_ts").alias("arrival_ms"),
    )


def batch_header_strip(spark: SparkSession, sf: str) -> DataFrame:
    # Batches of seven, so that header lines fall on every position of a batch.
    return batching.strip_batch_header(_batches(spark, sf, 7)).select("batch_id", _joined())


def _exploded_pms(batches: DataFrame) -> DataFrame:
    rows = batching.explode_batches(batches.select("batch_id", "is_last", "measurements"))
    m = F.col("measurement")
    return rows.select(
        "batch_id",
        "is_last",
        "position",
        m["sensor_id"].alias("sensor_id"),
        m["p1"].alias("p1"),
        m["p2"].alias("p2"),
        F.unix_millis(m["timestamp"]).alias("timestamp_ms"),
        m[STAMP].alias(STAMP),
    )


def batch_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded_pms(batching.parse_batches(_batches(spark, sf), "pms7003"))


def batch_explode(spark: SparkSession, sf: str) -> DataFrame:
    rows = batching.explode_batches(_batches(spark, sf))
    return rows.select("batch_id", "is_last", "position", F.col("measurement").alias("line"))


def batch_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    mixed = batching.shuffle_batches(_batches(spark, sf), seed=7)
    return mixed.select("batch_id", "is_last", _joined(F.sort_array("measurements")))


def batch_parse_job(spark: SparkSession, sf: str) -> DataFrame:
    folder = write_line_files(spark, sf, "pms7003")
    batches = jobs.batch_parse_job(spark, folder, seed=7)
    return _exploded_pms(batches).drop("position")


# --- trailing windows ----------------------------------------------------------------------


def _keyed_batches(spark: SparkSession, sf: str) -> DataFrame:
    timed = batching.batch_event_time(_batches(spark, sf, TRAILING_SIZE))
    return timed.withColumn("station", F.col("batch_id") % TRAILING_KEYS)


def trailing_day_bounds(spark: SparkSession, sf: str) -> DataFrame:
    bounds = trailing.trailing_bounds(_keyed_batches(spark, sf))
    return bounds.select("station", "batch_id", "after_batch_id")


def trailing_day_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of all batches: where each one begins, how many batches it holds and which."""
    bounds = trailing.trailing_bounds(_keyed_batches(spark, sf))
    counted = trailing.window_counts(bounds.select("station", "batch_id", "after_batch_id"), "station")
    listed = trailing.window_lists(counted, "station")
    return listed.select("station", "batch_id", "after_batch_id", "n_batches", "window_ids")


def stream_trailing_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by the watermark the engine holds, eight micro-batches in two runs."""
    labels = ("batches", "windows", "state")
    source, sink, state = (scratch_path(spark, label) for label in labels)
    batches = _keyed_batches(spark, sf).select("station", "batch_id", "event_ts")
    batches = settle(batches, "keyed")
    count = batches.count()
    part = F.expr(f"batch_id * {WATERMARK_PARTS} div {count}")
    for number in range(WATERMARK_PARTS):
        batches.filter(part == number).coalesce(1).write.mode("append").parquet(source)
        if number % (WATERMARK_PARTS // 2) == WATERMARK_PARTS // 2 - 1:
            stream = spark.readStream.schema(batches.schema).option("maxFilesPerTrigger", 1).parquet(source)
            windows = trailing_windows_stream(stream, ["station"], WATERMARK_HORIZON_MS)
            with rocksdb_state(spark):
                run_available(windows, sink, state)
    return spark.read.parquet(sink).select("station", "batch_id", "arrival_ms", "after_batch_id")


def stream_trailing_day(spark: SparkSession, sf: str) -> DataFrame:
    labels = ("batches", "days", "tags", "state")
    source, sink, tags, state = (scratch_path(spark, label) for label in labels)
    batches = settle(
        _keyed_batches(spark, sf).select("station", "batch_id", "arrival_ts"), "keyed"
    )
    half = batches.agg(F.max("batch_id")).first()[0] // 2
    for landed in (F.col("batch_id") <= half, F.col("batch_id") > half):
        batches.filter(landed).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batches.schema).parquet(source)
        trailing_bounds_stream(stream, sink, tags, state, availableNow=True).awaitTermination()
    return spark.read.parquet(sink).select("station", "batch_id", "after_batch_id")


# --- formats -------------------------------------------------------------------------------


def format_kind(kind: str) -> Query:
    form = {
        "base": formatting.format_base,
        "bmp280": formatting.format_bmp280,
        "bme280": formatting.format_bme280,
    }[kind]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return form(_readings(spark, sf, kind)).select("event_id", "line")

    return run


# --- latency -------------------------------------------------------------------------------


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Window results that each arrive some ms after their newest stamp, with ``ord``."""
    results = formatting.result_line(jobs.windowed_temperature(_lines(spark, sf, "bme280")))
    delay = F.expr("window_start_ms div 1000 % 997") + F.col("sensor_id") % 89
    arrived = latency.compute_latency(results, ingestion_ms=F.col("max_stamp") + delay)
    # Sensor ids are 32-bit numbers; minutes since the epoch take the bits above.
    order = F.expr("window_start_ms div 60000") * (1 << 32) + F.col("sensor_id")
    return arrived.withColumn("ord", order)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The latency log as lines, every 13th of them broken in one of three ways."""
    lines = latency.latency_line(_latencies(spark, sf))
    case = F.col("ord") % 39
    value = (
        F.when(case == 0, F.lit(""))
        .when(case == 26, F.concat_ws(",", "latency_ms", "ingestion_ts_ms"))
        .otherwise(F.concat(F.when(case == 13, F.lit("x")).otherwise(F.lit("")), F.col("value")))
    )
    return lines.select("ord", value.alias("value"))


def latency_compute(spark: SparkSession, sf: str) -> DataFrame:
    return _latencies(spark, sf).select("ord", "latency_ms", "event_ts_ms", "ingestion_ts_ms")


def latency_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = latency.parse_latency(_log(spark, sf), ("ord",))
    bounds = F.regexp_extract("result", r"^sensor=\d+ window=\[(\d+,\d+)\) avg=", 1)
    return parsed.withColumn("result", bounds)


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return latency.latency_summary(latency.parse_latency(_log(spark, sf)))


def relative_time(spark: SparkSession, sf: str) -> DataFrame:
    parsed = latency.parse_latency(_log(spark, sf), ("ord",))
    return latency.relative_time(parsed, "ord").select("ord", "rel_s")


def rolling_latency(spark: SparkSession, sf: str) -> DataFrame:
    parsed = number_rows(latency.parse_latency(_log(spark, sf), ("ord",)), "ord")
    rolling = latency.rolling_avg(parsed)
    return rolling.select("n", "ord", F.round("rolling_ms", 6).alias("rolling_ms"))


def latency_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report job over log files: the series with the rolling mean where there is one."""
    folder = scratch_path(spark, "latency-log")
    _log(spark, sf).orderBy("ord").select("value").write.text(folder)
    series = jobs.latency_report(spark, folder)["series"]
    return series.select("n", "latency_ms", "rel_s", F.round("rolling_ms", 6).alias("rolling_ms"))


def latency_loop(spark: SparkSession, sf: str) -> DataFrame:
    """From the result files of the window job to the latency of each result.

    The time of arrival is that of the run, so of the latency only its sign is given.
    """
    folder = scratch_path(spark, "results")
    results = jobs.windowed_temperature(_lines(spark, sf, "bme280"))
    line_sink(formatting.result_line_with_stamp(results), folder)
    parsed = latency.parse_latency(jobs.latency_log(spark, folder))
    part = lambda group: F.regexp_extract("result", r"^sensor=(\d+) window=\[(\d+),", group)
    return parsed.select(
        part(1).cast("int").alias("sensor_id"),
        part(2).cast("bigint").alias("window_start_ms"),
        "event_ts_ms",
        (F.col("latency_ms") >= 0).alias("arrived_after"),
    )


def _arrivals(results: DataFrame) -> DataFrame:
    """Arrivals of results; a seventh never arrives, and an eleventh two hours late."""
    order = F.expr("window_start_ms div 60000") * (1 << 32) + F.col("sensor_id")
    delay = F.expr("window_start_ms div 1000 % 997") + F.col("sensor_id") % 89
    late = F.when(order % 11 == 0, 2 * 3_600_000).otherwise(delay)
    came = results.filter(order % 7 != 0)
    return came.select("sensor_id", "window_start_ms", (F.col("max_stamp") + late).alias("ingestion_ts_ms"))


_MATCHED = ("sensor_id", "window_start_ms", "event_ts_ms", "ingestion_ts_ms", "latency_ms")


def latency_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Latency of results and arrivals that are two tables."""
    results = settle(jobs.windowed_temperature(_lines(spark, sf, "bme280")), "results")
    return match_arrivals(results, _arrivals(results)).select(*_MATCHED)


def stream_latency_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Latency of results and arrivals that are two streams, over three runs."""
    labels = ("results", "arrivals", "matched", "state")
    folders = [scratch_path(spark, label) for label in labels]
    results = settle(jobs.windowed_temperature(_lines(spark, sf, "bme280")), "all-results")
    arrivals = _arrivals(results)
    low, high = results.agg(F.min("max_stamp"), F.max("max_stamp")).first()
    cuts = [low, low + (high - low) // 3, low + (high - low) * 2 // 3, 1 << 62]
    for first, after in zip(cuts, cuts[1:]):
        streams = []
        for table, time, folder in zip((results, arrivals), ("max_stamp", "ingestion_ts_ms"), folders):
            landed = table.filter((F.col(time) >= first) & (F.col(time) < after))
            landed.write.mode("append").parquet(folder)
            streams.append(spark.readStream.schema(table.schema).parquet(folder))
        run_available(match_arrivals(*streams), *folders[2:])
    written = spark.read.parquet(folders[2])
    return written.unionByName(open_results(spark, folders[3], written)).select(*_MATCHED)


def stream_latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    source, parts, state = (scratch_path(spark, label) for label in ("log", "parts", "state"))
    log = settle(_log(spark, sf), "log")
    for part in range(3):
        log.filter(F.col("ord") % 3 == part).select("value").write.mode("append").text(source)
        parsed = latency.parse_latency(stream_lines(spark, source))
        running_latency(parsed, parts, state, availableNow=True).awaitTermination()
    return latency_so_far(spark, parts)


QUERIES: dict[str, Query] = {
    "q_tumbling_avg_1m": tumbling_avg("1 minute"),
    "q_tumbling_avg_1h": tumbling_avg("1 hour"),
    "q_tumbling_avg_1d": tumbling_avg("1 day"),
    "q_parse_base": parse_kind("base"),
    "q_parse_pms7003": parse_kind("pms7003"),
    "q_parse_bmp280": parse_kind("bmp280"),
    "q_parse_bme280": parse_kind("bme280"),
    "q_header_filter": header_filter,
    "q_valid_readings": valid_readings,
    "q_rejected_readings": rejected_readings,
    "q_reject_report": reject_report,
    "q_stamp_lines": stamp_lines,
    "q_avg_empty_nan": avg_empty_nan,
    "q_avg_max_stamp": avg_max_stamp,
    "q_rollup_hour_to_day": rollup_hour_to_day,
    "q_result_lines": result_lines,
    "q_file_tumbling_1m": file_tumbling,
    "q_stream_tumbling_1d": stream_tumbling_1d,
    "q_stream_lines_job": stream_lines_job,
    "q_stream_rollup_hour_to_day": stream_rollup,
    "q_count_batches": count_batches,
    "q_file_batches": file_batches,
    "q_batch_event_time": batch_event_time,
    "q_batch_header_strip": batch_header_strip,
    "q_batch_parse": batch_parse,
    "q_batch_explode": batch_explode,
    "q_batch_shuffle": batch_shuffle,
    "q_batch_parse_job": batch_parse_job,
    "q_trailing_day_batches": trailing_day_batches,
    "q_trailing_day_bounds": trailing_day_bounds,
    "q_stream_trailing_day": stream_trailing_day,
    "q_format_base": format_kind("base"),
    "q_format_bmp280": format_kind("bmp280"),
    "q_format_bme280": format_kind("bme280"),
    "q_latency_compute": latency_compute,
    "q_latency_parse": latency_parse,
    "q_latency_summary": latency_summary,
    "q_relative_time": relative_time,
    "q_rolling_latency": rolling_latency,
    "q_latency_report": latency_report,
    "q_latency_loop": latency_loop,
    "q_print_sink": printed_lines,
    "q_stream_published_lines": stream_published,
    "q_stream_growing_files": stream_growing,
    "q_stream_windows_update": stream_windows_update,
    "q_stream_reject_report": stream_rejects,
    "q_stream_averages": stream_averages,
    "q_stream_count_batches": stream_count_batches,
    "q_stream_trailing_watermark": stream_trailing_watermark,
    "q_latency_arrivals": latency_arrivals,
    "q_stream_latency_arrivals": stream_latency_arrivals,
    "q_stream_latency_summary": stream_latency_summary,
}
