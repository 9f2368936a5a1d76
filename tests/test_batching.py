from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import scans
from gaugeworks.operators.batching import (
    batch_event_time,
    count_batches,
    explode_batches,
    parse_batches,
    read_batches,
    shuffle_batches,
    strip_batch_header,
)
from gaugeworks.operators.scans import exclusive_prefix, number_rows
from gaugeworks.plans.jobs import batch_parse_job
from gaugeworks.sources import numbered as numbered_source
from gaugeworks.sources.numbered import number_file_lines

NOW = datetime(2024, 3, 1, 12)


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def timed(second):
    return ";;;;;" + (NOW + timedelta(seconds=second)).isoformat()


def test_batches_of_a_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["header values"] + [timed(s) for s in range(5)])
    rows = batch_event_time(read_batches(spark, path, 2)).orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == [0, 1, 2]
    assert [r.is_last for r in rows] == [False, False, True]
    assert [r.event_ts for r in rows] == [NOW + timedelta(seconds=s) for s in (1, 3, 4)]
    assert [r.arrival_ts for r in rows] == [None] + [NOW + timedelta(seconds=s) for s in (1, 3)]
    assert [list(r.measurements) for r in rows] == [
        [timed(0), timed(1)], [timed(2), timed(3)], [timed(4)],
    ]


def test_full_last_batch_and_empty_inputs(spark, tmp_path):
    full = write(tmp_path / "full.csv", ["h"] + [timed(s) for s in range(4)])
    assert [r.is_last for r in read_batches(spark, full, 2).orderBy("batch_id").collect()] == [False, True]
    only_header = write(tmp_path / "h.csv", ["h"])
    assert read_batches(spark, only_header, 2).collect() == []


def test_event_time_is_a_running_maximum(spark, tmp_path):
    order = [5, 1, 2, 0, 9, 3]
    lines = ["h"] + [timed(s) for s in order] + ["no time", "a,b,c,d,e," + NOW.isoformat()]
    path = write(tmp_path / "x.csv", lines)
    rows = batch_event_time(read_batches(spark, path, 2)).orderBy("batch_id").collect()
    assert [r.event_ts for r in rows] == [NOW + timedelta(seconds=s) for s in (5, 5, 9, 9)]


@pytest.mark.parametrize("limit,per_task", [(1 << 20, 10_000), (0, 10_000), (1 << 20, 3)])
def test_lines_are_numbered_over_files_and_splits(spark, tmp_path, monkeypatch, limit, per_task):
    monkeypatch.setattr(numbered_source, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(numbered_source, "SPLITS_PER_TASK", per_task)
    expected = []
    for number, count in enumerate([3000, 1, 0, 777]):
        lines = [f"{number}:{i}" + "x" * (i % 40) for i in range(count)]
        path = tmp_path / "lines" / f"f{number}.txt"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(line + "\n" for line in ["title", *lines]))
        expected += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert spark.read.text(str(tmp_path / "lines")).rdd.getNumPartitions() > 4
        lines = number_file_lines(spark, str(tmp_path / "lines"))
        rows = sorted(lines.collect(), key=lambda r: r.n)
        assert [r.n for r in rows] == list(range(len(expected)))
        assert [r.value for r in rows] == expected
        assert {r.total for r in rows} == {len(expected)}
        kept = number_file_lines(spark, str(tmp_path / "lines"), skip_first=False)
        assert kept.count() == len(expected) + 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("bits", [2, 17])
def test_numbering_and_prefixes_on_sparse_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(scans, "GROUP_BITS", bits)
    monkeypatch.setattr(scans, "ROW_GROUP_BITS", 3)
    keys = sorted({(i * i * 37) % 4001 - 500 for i in range(900)})
    rows = spark.createDataFrame([(k, k % 11) for k in reversed(keys)], "k bigint, v int")
    got = number_rows(rows, "k").orderBy("k").collect()
    assert [(r.k, r.n, r.total) for r in got] == [(k, n, len(keys)) for n, k in enumerate(keys)]
    for fold, start, step in (("sum", 0, lambda a, b: a + b), ("max", None, lambda a, b: b if a is None else max(a, b))):
        wanted, so_far = [], start
        for k in keys:
            wanted.append((k, so_far))
            so_far = step(so_far, k % 11)
        found = exclusive_prefix(rows, "k", "v", fold).orderBy("k").collect()
        assert [(r.k, r.before) for r in found] == wanted
        assert {r.overall for r in found} == {so_far}


@pytest.mark.parametrize("keys,message", [([1, 2, None], "has no k"), ([1, 1, 2], "two rows to number have k 1")])
def test_rows_need_an_order(spark, keys, message):
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    with pytest.raises(Exception, match=message):
        number_rows(rows, "k").collect()


def test_file_lines_are_shuffled_once(spark, tmp_path):
    """The only exchange of lines is the one by batch id."""
    write(tmp_path / "a.csv", ["h"] + [timed(s) for s in range(50)])
    batches = read_batches(spark, str(tmp_path), 10)
    plan = batches._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "BroadcastHashJoin [part" in plan
    below_join = plan[plan.index("BroadcastHashJoin [part") :]
    above_scan = below_join[: below_join.index("FileScan text")]
    assert "Exchange hashpartitioning" not in above_scan.split("BroadcastExchange")[0]


def batch_frame(spark, *batches):
    return spark.createDataFrame(
        [(i, i == len(batches) - 1, b) for i, b in enumerate(batches)],
        "batch_id bigint, is_last boolean, measurements array<string>",
    )


def test_header_is_stripped_only_in_front(spark):
    frame = batch_frame(spark, ["sensor_id;x", "a"], ["a", "sensor_id;x"], [], ["sensor_id"])
    got = [r.measurements for r in strip_batch_header(frame).orderBy("batch_id").collect()]
    assert got == [["a"], ["a", "sensor_id;x"], [], []]


def test_shuffle_mixes_full_batches_only(spark):
    lines = [f"l{i}" for i in range(40)]
    frame = batch_frame(spark, lines, lines, lines[:39])
    first = {r.batch_id: r.measurements for r in shuffle_batches(frame, 40, seed=5).collect()}
    again = shuffle_batches(frame.repartition(3), 40, seed=5).collect()
    assert first == {r.batch_id: r.measurements for r in again}
    other = {r.batch_id: r.measurements for r in shuffle_batches(frame, 40, seed=6).collect()}
    assert first[0] != lines and first[0] != first[1] and first[0] != other[0]
    assert sorted(first[0]) == sorted(first[1]) == sorted(lines)
    assert first[2] == lines[:39]
    assert sorted(shuffle_batches(frame, 40).first().measurements) == sorted(lines)


def test_parse_and_explode_keep_ids_and_flags(spark):
    line = "1;PMS7003;2;3.0;4.0;2020-01-01T00:00:01;20.2;17.8;9.6"
    parsed = parse_batches(batch_frame(spark, [line, ""], [line]), "pms7003")
    rows = explode_batches(parsed).orderBy("batch_id", "position").collect()
    assert [(r.batch_id, r.is_last, r.position) for r in rows] == [(0, False, 0), (0, False, 1), (1, True, 0)]
    assert [r.measurement.p2 for r in rows] == [17.8, None, 17.8]
    assert rows[0].measurement.timestamp == datetime(2020, 1, 1, 0, 0, 1)


def test_job_equals_the_single_operators(spark, tmp_path):
    line = "{0};PMS7003;2;3.0;4.0;2020-01-01T00:00:01;20.2;17.8;{0}.5"
    lines = ["title"] + ["sensor_id;x" if i % 3 == 0 else line.format(i) for i in range(47)]
    path = write(tmp_path / "pms.csv", lines)
    job = batch_parse_job(spark, path, size=5, seed=11)
    steps = batch_event_time(read_batches(spark, path, 5))
    steps = parse_batches(strip_batch_header(shuffle_batches(steps, 5, seed=11)), "pms7003")
    columns = ["batch_id", "is_last", "event_ts", "measurements"]
    assert job.select(columns).orderBy("batch_id").collect() == steps.select(columns).orderBy("batch_id").collect()
    assert min(len(r.measurements) for r in job.collect()) < 5


def test_batches_of_a_table(spark):
    rows = spark.range(95, 0, -1, 4).select((F.col("id") * 1_000_003).alias("o"), F.col("id").cast("string").alias("value"))
    got = count_batches(number_rows(rows, "o"), 10).orderBy("batch_id").collect()
    assert [r.measurements for r in got] == [[str(i) for i in range(s, min(s + 10, 96))] for s in range(1, 96, 10)]
