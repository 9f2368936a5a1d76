"""The catalog's queries as SQL over the same tables, to check results against.

Written from the table columns and the defect rules of ``event_lines``; nothing here parses lines.
"""

from __future__ import annotations

from gaugeworks.plans.catalog import (
    TRAILING_KEYS,
    TRAILING_SIZE,
    WATERMARK_HORIZON_MS,
    WATERMARK_PARTS,
)

DAY_MS = 86_400_000

EVENTS = """
ev AS (
  SELECT event_id, user_id, value, epoch_us(ts) // 1000 AS stamp,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS sensor_id,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) // 1000 END AS t,
    CASE WHEN event_id % 29 = 0 THEN NULL
         ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END AS time_text,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS main,
    CAST(user_id % 25 AS INTEGER) AS location,
    CAST(50 AS DOUBLE) + user_id / CAST(1000 AS DOUBLE) AS lat,
    CAST(20 AS DOUBLE) + user_id / CAST(1000 AS DOUBLE) AS lon,
    CAST(1000 AS DOUBLE) + value / CAST(10 AS DOUBLE) AS pressure,
    event_id % 100 + CAST(0.5 AS DOUBLE) AS second_value
  FROM events
)"""

METRICS = {
    "base": {},
    "pms7003": {"p1": "main", "p2": "second_value", "p0": "CAST(9.6 AS DOUBLE)"},
    "bmp280": {
        "pressure": "pressure",
        "altitude": "CAST(150 AS DOUBLE)",
        "pressure_at_sea_level": "CAST(1013.25 AS DOUBLE)",
        "temperature": "main",
    },
}
METRICS["bme280"] = {**METRICS["bmp280"], "humidity": "second_value"}
LINE_TEXTS = {"p0": "'9.60'", "altitude": "'150.0'", "pressure_at_sea_level": "'1013.25'"}
BASE_NAMES = "sensor_id;sensor_type;location;lat;lon;timestamp"


def _text(expression: str, null_text: str) -> str:
    return f"coalesce(CAST({expression} AS VARCHAR), '{null_text}')"


def lines(kind: str, stamped: bool = True) -> str:
    """Common table of the event lines with their headers: ord, stamp, t, value."""
    fields = [
        _text("sensor_id", "x"),
        f"'{kind.upper()}'",
        "CAST(location AS VARCHAR)",
        "CAST(lat AS VARCHAR)",
        "CAST(lon AS VARCHAR)",
        _text("time_text", "bad"),
    ] + [LINE_TEXTS.get(name) or _text(value, "") for name, value in METRICS[kind].items()]
    tail = " || ',' || CAST(stamp AS VARCHAR)" if stamped else ""
    header = ";".join([BASE_NAMES, *METRICS[kind]])
    return f"""{EVENTS},
lines AS (
  SELECT event_id * 2 + 1 AS ord, event_id, stamp, t,
    concat_ws(';', {", ".join(fields)}){tail} AS value FROM ev
  UNION ALL
  SELECT event_id * 2, event_id, stamp, NULL, '{header}' FROM ev WHERE event_id % 1000 = 0
)"""


def parse_kind(kind: str) -> str:
    metrics = "".join(f", {value} AS {name}" for name, value in METRICS[kind].items())
    return f"""WITH {EVENTS}
SELECT event_id, sensor_id, '{kind.upper()}' AS sensor_type, location, lat, lon,
  t AS timestamp_ms{metrics}, stamp AS datagen_ts FROM ev"""


def results(step_ms: int) -> str:
    return f"""{EVENTS},
res AS (
  SELECT sensor_id, t // {step_ms} * {step_ms} AS window_start_ms,
    t // {step_ms} * {step_ms} + {step_ms} AS window_end_ms,
    avg(main) AS avg_temp, max(stamp) AS max_stamp
  FROM ev WHERE sensor_id IS NOT NULL AND main IS NOT NULL AND t IS NOT NULL
  GROUP BY ALL
)"""


def tumbling(step_ms: int) -> str:
    return f"""WITH {results(step_ms)}
SELECT sensor_id, window_start_ms, window_end_ms, round(avg_temp, 6) AS avg_temp, max_stamp FROM res"""


# Three decimals, ties away from zero on the shortest decimal form.
AVG_TEXT = (
    "CAST(CAST(round(CAST(CAST(avg_temp AS VARCHAR) AS DECIMAL(38, 18)), 3) "
    "AS DECIMAL(18, 3)) AS VARCHAR)"
)
PLAIN_LINE = (
    "'sensor=' || sensor_id || ' window=[' || window_start_ms || ',' || window_end_ms || ') avg=' || "
    + AVG_TEXT
)


def batches(kind: str, size: int) -> str:
    return f"""{lines(kind)},
placed AS (
  SELECT ord, t, value, row_number() OVER (ORDER BY ord) - 2 AS n, count(*) OVER () - 1 AS total
  FROM lines
),
numbered AS (
  SELECT *, n // {size} AS batch_id, n // {size} = (total - 1) // {size} AS is_last
  FROM placed WHERE n >= 0
)"""


def file_batches(size: int) -> str:
    """Batches of the line files: only each file's first line is a header."""
    return f"""{lines("pms7003")},
placed AS (
  SELECT event_id, value, row_number() OVER (ORDER BY ord) - 1 AS n, count(*) OVER () AS total
  FROM lines WHERE ord % 2 = 1
),
numbered AS (
  SELECT *, n // {size} AS batch_id, n // {size} = (total - 1) // {size} AS is_last FROM placed
)"""


def batch_times(size: int) -> str:
    return f"""{batches("pms7003", size)},
own AS (SELECT batch_id, max(t) AS newest FROM numbered GROUP BY batch_id),
timed AS (
  SELECT batch_id, max(newest) OVER (ORDER BY batch_id) AS event_ms,
    max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm,
    batch_id % {TRAILING_KEYS} AS station
  FROM own
)"""


JOINED = "string_agg(value, '|' ORDER BY n) AS lines"

BOUND_ROWS = f"""SELECT a.station, a.batch_id,
  CASE WHEN a.wm IS NULL THEN a.batch_id - 1 ELSE coalesce((
    SELECT max(b.batch_id) FROM timed b
    WHERE b.batch_id < a.batch_id AND (b.wm IS NULL OR b.wm <= a.wm - {DAY_MS})
  ), -1) END AS after_batch_id
FROM timed a"""
BOUNDS = f"WITH {batch_times(TRAILING_SIZE)} {BOUND_ROWS}"

# The batches of a window counted and listed one by one.
TRAILING = f"""WITH {batch_times(TRAILING_SIZE)},
bounds AS ({BOUND_ROWS}),
members AS (
  SELECT a.station, a.batch_id, count(*) AS n_batches,
    string_agg(CAST(b.batch_id AS VARCHAR), ',' ORDER BY b.batch_id) AS window_ids
  FROM timed a JOIN timed b ON a.station = b.station AND (
    a.batch_id = b.batch_id OR (b.batch_id < a.batch_id AND b.wm > a.wm - {DAY_MS}))
  GROUP BY a.station, a.batch_id
)
SELECT station, batch_id, after_batch_id, n_batches, window_ids
FROM bounds JOIN members USING (station, batch_id)"""

# The watermark of a micro-batch is the newest time of all before it.
WATERMARKS = f"""WITH {batch_times(TRAILING_SIZE)},
parts AS (
  SELECT station, batch_id, event_ms, batch_id * {WATERMARK_PARTS} // count(*) OVER () AS part FROM timed
),
marks AS (
  SELECT part, max(max(event_ms)) OVER (
    ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM parts GROUP BY part
),
tagged AS (SELECT station, batch_id, part, mark FROM parts JOIN marks USING (part))
SELECT a.station, a.batch_id, a.mark AS arrival_ms,
  CASE WHEN a.mark IS NULL THEN a.batch_id - 1 ELSE coalesce((
    SELECT max(b.batch_id) FROM tagged b
    WHERE b.station = a.station AND b.part < a.part
      AND (b.mark IS NULL OR b.mark <= a.mark - {WATERMARK_HORIZON_MS})
  ), -1) END AS after_batch_id
FROM tagged a"""

PMS_FIELDS = """
  CASE WHEN ord % 2 = 1 THEN ev.sensor_id END AS sensor_id,
  CASE WHEN ord % 2 = 1 THEN ev.main END AS p1,
  CASE WHEN ord % 2 = 1 THEN ev.second_value END AS p2,
  numbered.t AS timestamp_ms,
  CASE WHEN ord % 2 = 1 THEN ev.stamp ELSE 0 END AS datagen_ts"""


def averages(stamp: bool) -> str:
    newest = (
        ", coalesce(max(CASE WHEN main IS NOT NULL THEN stamp END), "
        "CAST(-9223372036854775808 AS BIGINT)) AS max_stamp"
        if stamp
        else ""
    )
    return f"""WITH {EVENTS}
SELECT sensor_id, t // 60000 AS minute, count(main) = 0 AS is_nan,
  round(coalesce(avg(main), 0), 6) AS avg_temp{newest}
FROM ev GROUP BY sensor_id, t // 60000"""


REJECTS = f"""{EVENTS},
rejects AS (
  SELECT event_id, concat_ws('+', CASE WHEN sensor_id IS NULL THEN 'no_sensor_id' END,
    CASE WHEN t IS NULL THEN 'no_timestamp' END, CASE WHEN main IS NULL THEN 'no_temperature' END
  ) AS reasons FROM ev WHERE sensor_id IS NULL OR t IS NULL OR main IS NULL
)"""


def formatted(kind: str, separator: str, null_text: str, stamp: bool) -> str:
    fields = [
        _text("sensor_id", "null"),
        f"'{kind.upper()}'",
        "CAST(location AS VARCHAR)",
        "CAST(lat AS VARCHAR)",
        "CAST(lon AS VARCHAR)",
        _text("time_text || 'Z'", null_text),
    ] + [_text(value, null_text) for value in METRICS[kind].values()]
    if stamp:
        fields.append("CAST(stamp AS VARCHAR)")
    return f"""WITH {EVENTS}
SELECT event_id, concat_ws('{separator}', {", ".join(fields)}) AS line FROM ev"""


LATENCIES = f"""{results(60_000)},
lat AS (
  SELECT window_start_ms // 60000 * 4294967296 + sensor_id AS ord,
    window_start_ms // 1000 % 997 + sensor_id % 89 AS latency_ms,
    window_start_ms || ',' || window_end_ms AS result, max_stamp AS event_ts_ms,
    max_stamp + window_start_ms // 1000 % 997 + sensor_id % 89 AS ingestion_ts_ms
  FROM res
),
log AS (
  SELECT *, row_number() OVER (ORDER BY ord) - 1 AS n,
    (ingestion_ts_ms - first_value(ingestion_ts_ms) OVER (ORDER BY ord)) / CAST(1000 AS DOUBLE) AS rel_s,
    avg(latency_ms) OVER (ORDER BY ord ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean_50
  FROM lat WHERE ord % 13 <> 0
)"""

ARRIVALS = f"""{results(60_000)},
named AS (
  SELECT *, window_start_ms // 60000 * 4294967296 + sensor_id AS ord,
    window_start_ms // 1000 % 997 + sensor_id % 89 AS delay FROM res
)
SELECT sensor_id, window_start_ms, max_stamp AS event_ts_ms,
  CASE WHEN ord % 7 <> 0 AND ord % 11 <> 0 THEN max_stamp + delay END AS ingestion_ts_ms,
  CASE WHEN ord % 7 <> 0 AND ord % 11 <> 0 THEN delay END AS latency_ms
FROM named"""

ORACLES: dict[str, str] = {
    "q_tumbling_avg_1m": tumbling(60_000),
    "q_tumbling_avg_1h": tumbling(3_600_000),
    "q_tumbling_avg_1d": tumbling(DAY_MS),
    "q_parse_base": parse_kind("base"),
    "q_parse_pms7003": parse_kind("pms7003"),
    "q_parse_bmp280": parse_kind("bmp280"),
    "q_parse_bme280": parse_kind("bme280"),
    "q_header_filter": f"WITH {lines('bme280')} SELECT ord, value FROM lines WHERE ord % 2 = 1",
    "q_valid_readings": f"""WITH {EVENTS} SELECT event_id, sensor_id, main AS temperature FROM ev
WHERE sensor_id IS NOT NULL AND main IS NOT NULL""",
    "q_rejected_readings": f"WITH {REJECTS} SELECT event_id, reasons FROM rejects",
    "q_reject_report": f"""WITH {REJECTS},
reasons AS (SELECT unnest(string_split(reasons, '+')) AS reason FROM rejects)
SELECT reason, count(*) AS n FROM reasons GROUP BY reason""",
    "q_stamp_lines": f"""WITH {lines("pms7003", stamped=False)}
SELECT ord, value || ',' || stamp AS value FROM lines""",
    "q_avg_empty_nan": averages(stamp=False),
    "q_avg_max_stamp": averages(stamp=True),
    "q_rollup_hour_to_day": tumbling(DAY_MS),
    "q_result_lines": f"""WITH {results(60_000)}
SELECT sensor_id, window_start_ms, {PLAIN_LINE} AS plain_line,
  {PLAIN_LINE} || ',' || max_stamp AS line FROM res""",
    "q_file_tumbling_1m": tumbling(60_000),
    "q_stream_tumbling_1d": tumbling(DAY_MS),
    "q_stream_rollup_hour_to_day": tumbling(DAY_MS),
    "q_stream_lines_job": f"""WITH {results(60_000)}
SELECT sensor_id, window_start_ms, window_end_ms, {AVG_TEXT} AS avg_text, max_stamp FROM res""",
    "q_count_batches": f"""WITH {batches("pms7003", 100)}
SELECT batch_id, is_last, {JOINED} FROM numbered GROUP BY batch_id, is_last""",
    "q_file_batches": f"""WITH {file_batches(100)}
SELECT batch_id, is_last, {JOINED} FROM numbered GROUP BY batch_id, is_last""",
    "q_batch_event_time": f"""WITH {batch_times(100)}
SELECT batch_id, event_ms, wm AS arrival_ms FROM timed""",
    "q_batch_header_strip": f"""WITH {batches("pms7003", 7)}
SELECT batch_id, string_agg(value, '|' ORDER BY n)
  FILTER (WHERE NOT (n % 7 = 0 AND ord % 2 = 0)) AS lines
FROM numbered GROUP BY batch_id""",
    "q_batch_parse": f"""WITH {batches("pms7003", 100)}
SELECT batch_id, is_last, n % 100 AS position, {PMS_FIELDS}
FROM numbered JOIN ev ON ev.event_id = numbered.ord // 2""",
    "q_batch_explode": f"""WITH {batches("pms7003", 100)}
SELECT batch_id, is_last, n % 100 AS position, value AS line FROM numbered""",
    "q_batch_shuffle": f"""WITH {batches("pms7003", 100)}
SELECT batch_id, is_last, string_agg(value, '|' ORDER BY value) AS lines
FROM numbered GROUP BY batch_id, is_last""",
    "q_batch_parse_job": f"""WITH {file_batches(100)}
SELECT batch_id, is_last, ev.sensor_id, ev.main AS p1, ev.second_value AS p2,
  ev.t AS timestamp_ms, ev.stamp AS datagen_ts
FROM numbered JOIN ev ON ev.event_id = numbered.event_id""",
    "q_trailing_day_batches": TRAILING,
    "q_trailing_day_bounds": BOUNDS,
    "q_stream_trailing_day": BOUNDS,
    "q_format_base": formatted("base", ";", "null", stamp=True),
    "q_format_bmp280": formatted("bmp280", ";", "null", stamp=False),
    "q_format_bme280": formatted("bme280", ",", "", stamp=False),
    "q_latency_compute": f"""WITH {LATENCIES}
SELECT ord, latency_ms, event_ts_ms, ingestion_ts_ms FROM lat""",
    "q_latency_parse": f"""WITH {LATENCIES}
SELECT ord, latency_ms, result, event_ts_ms, ingestion_ts_ms FROM log""",
    "q_latency_summary": f"""WITH {LATENCIES}
SELECT count(*) AS tuples, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
  round(avg(latency_ms), 1) AS avg_ms FROM log""",
    "q_relative_time": f"WITH {LATENCIES} SELECT ord, rel_s FROM log",
    "q_rolling_latency": f"""WITH {LATENCIES}
SELECT n, ord, round(mean_50, 6) AS rolling_ms FROM log WHERE n >= 49""",
    "q_latency_loop": f"""WITH {results(60_000)}
SELECT sensor_id, window_start_ms, max_stamp AS event_ts_ms, TRUE AS arrived_after FROM res""",
    "q_latency_report": f"""WITH {LATENCIES}
SELECT n, latency_ms, rel_s, CASE WHEN n >= 49 THEN round(mean_50, 6) END AS rolling_ms FROM log""",
    "q_print_sink": f"""WITH {results(60_000)}
SELECT {PLAIN_LINE} || ',' || max_stamp AS line FROM res""",
    "q_stream_growing_files": tumbling(DAY_MS),
    "q_stream_windows_update": tumbling(DAY_MS),
    "q_stream_averages": f"""WITH {EVENTS}
SELECT sensor_id, count(main) = 0 AS is_nan, round(coalesce(avg(main), 0), 6) AS avg_temp
FROM ev GROUP BY sensor_id""",
    "q_stream_count_batches": f"""WITH {file_batches(100)},
own AS (
  SELECT batch_id, is_last, string_agg(numbered.value, '|' ORDER BY n) AS lines, max(ev.t) AS newest
  FROM numbered JOIN ev USING (event_id) GROUP BY batch_id, is_last
)
SELECT batch_id, is_last, lines, max(newest) OVER (ORDER BY batch_id) AS event_ms,
  max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS arrival_ms
FROM own""",
    "q_stream_trailing_watermark": WATERMARKS,
    "q_latency_arrivals": f"WITH {ARRIVALS}",
    "q_stream_latency_arrivals": f"WITH {ARRIVALS}",
}
ORACLES["q_stream_published_lines"] = ORACLES["q_stream_lines_job"]
ORACLES["q_stream_reject_report"] = ORACLES["q_reject_report"]
ORACLES["q_stream_latency_summary"] = ORACLES["q_latency_summary"]
