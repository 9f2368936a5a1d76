import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import latency
from gaugeworks.operators.latency import (
    compute_latency,
    latency_line,
    latency_summary,
    parse_latency,
    relative_time,
    rolling_avg,
)
from gaugeworks.plans.jobs import latency_log, latency_report

SAMPLE = "237,sensor=141 window=[1577836800000,1577836860000) avg=4.280,1780849502772,1780849503009"


def test_sample_line(frame):
    row = parse_latency(frame(SAMPLE)).first()
    assert (row.latency_ms, row.event_ts_ms, row.ingestion_ts_ms) == (237, 1780849502772, 1780849503009)
    assert row.result == "sensor=141 window=[1577836800000,1577836860000) avg=4.280"


@pytest.mark.parametrize("line", ["", "   ", "5,6", "x,a,7", "5,a,7.0", "5,a,", ",a,7", "1__0,a,7", "5"])
def test_bad_lines_are_dropped(frame, line):
    assert parse_latency(frame(line)).collect() == []


@pytest.mark.parametrize("line,first,last", [("5,a,7", 5, 7), (" +5 ,\t 7\r", 5, None), (" -5 ,x, 1_0\r", -5, 10),
                                             ("5,,7", 5, 7), ("5,a,b,c,d,7", 5, 7)])
def test_lenient_numbers(frame, line, first, last):
    rows = parse_latency(frame(line)).collect()
    assert [(r.latency_ms, r.ingestion_ts_ms) for r in rows] == ([] if last is None else [(first, last)])


def test_latency_is_ingestion_minus_newest_stamp(spark):
    results = spark.createDataFrame([("text", 1780849502772)], "line string, max_stamp bigint")
    row = latency_line(compute_latency(results, ingestion_ms=F.lit(1780849503009))).first()
    assert (row.latency_ms, row.value) == (237, "237,text,1780849502772,1780849503009")
    assert compute_latency(results).first().ingestion_ts_ms > 1_700_000_000_000


def series(spark, values):
    rows = [(i, v, 1000 + 10 * i if i else 5000) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n bigint, latency_ms bigint, ingestion_ts_ms bigint").repartition(3)


def test_summary_and_relative_time(spark):
    data = series(spark, [5, 1, 4])
    assert tuple(latency_summary(data).first()) == (3, 1, 5, 3.3)
    got = {r.n: r.rel_s for r in relative_time(data).collect()}
    assert got == {0: 0.0, 1: -3.99, 2: -3.98}  # since the first row, not the earliest


@pytest.mark.parametrize("count,rows", [(49, 50), (50, 50), (51, 50), (400, 50), (100, 1), (100, 16), (100, 17), (100, 40)])
def test_rolling_mean(spark, monkeypatch, count, rows):
    monkeypatch.setattr(latency, "_BLOCK_ROWS", 16)
    values = [(i * 31) % 97 for i in range(count)]
    got = {r.n: r.rolling_ms for r in rolling_avg(series(spark, values), rows).collect()}
    assert got == {i: sum(values[i - rows + 1 : i + 1]) / rows for i in range(rows - 1, count)}


def test_report_over_files(spark, tmp_path):
    lines = []
    for i in range(120):
        lines.append(f"{i % 13},r a,b,{1000 + i},{2000 + i * 7}")
        if i % 10 == 0:
            lines += ["", "bad,line", "1,x,y"]
    for part in range(3):
        (tmp_path / f"log{part}").write_text("\n".join(lines[part * 60 : (part + 1) * 60]) + "\n")
    report = latency_report(spark, str(tmp_path))
    assert report["summary"].first().tuples == 120
    rows = report["series"].orderBy("n").collect()
    assert [(r.n, r.rel_s) for r in rows] == [(i, i * 7 / 1000) for i in range(120)]
    rolling = {r.n: r.rolling_ms for r in rows}
    assert rolling == {
        i: sum(j % 13 for j in range(i - 49, i + 1)) / 50 if i >= 49 else None for i in range(120)
    }


def test_latency_counts_the_time_until_the_file_is_there(spark, tmp_path):
    """A result that waits for its micro-batch shows the wait."""
    import os

    path = tmp_path / "results" / "part-0.txt"
    path.parent.mkdir()
    path.write_text("sensor=1 window=[0,60000) avg=1.500,1700000000000\nno result\n")
    os.utime(path, (1_700_000_007, 1_700_000_007))
    rows = parse_latency(latency_log(spark, str(path.parent))).collect()
    assert [(r.latency_ms, r.result, r.event_ts_ms) for r in rows] == [
        (7000, "sensor=1 window=[0,60000) avg=1.500", 1_700_000_000_000)
    ]
