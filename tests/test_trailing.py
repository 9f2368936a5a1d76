import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.trailing import (
    DAY_MS,
    trailing_bounds,
    window_counts,
    window_lists,
    window_members,
)
from gaugeworks.plans.catalog import QUERIES
from gaugeworks.plans.catalog_sql import ORACLES
from gaugeworks.streaming.runs import run_available
from gaugeworks.streaming.trailing import trailing_bounds_stream, trailing_windows_stream


def replay(rows, horizon=DAY_MS):
    """Keep, per key, what is within the horizon at each arrival; rows are (key, id, tag)."""
    kept, out = {}, {}
    for key, batch_id, tag in rows:
        live = [
            (i, t) for i, t in kept.get(key, [])
            if t is not None and tag is not None and t > tag - horizon
        ]
        kept[key] = live + [(batch_id, tag)]
        out[key, batch_id] = [i for i, _ in kept[key]]
    return out


def frame(spark, rows):
    data = spark.createDataFrame(rows, "k int, batch_id bigint, tag bigint")
    return data.select("k", "batch_id", F.timestamp_millis("tag").alias("arrival_ts"))


def lists(spark, rows, horizon=DAY_MS):
    batches = frame(spark, rows)
    got = {(k, i): [] for k, i, _ in rows}
    for r in window_members(trailing_bounds(batches, horizon), batches, "k", 16).collect():
        got[r.k, r.batch_id].append(r.member_id)
    return {place: sorted(ids) for place, ids in got.items()}


KNOWN = [None, 0, 3_600_000, 86_400_000, 86_400_000, 90_000_001]


def test_known_case(spark):
    rows = [(1, i, tag) for i, tag in enumerate(KNOWN)]
    wanted = [[0], [1], [1, 2], [2, 3], [2, 3, 4], [3, 4, 5]]
    got = lists(spark, rows)
    assert [got[1, i] for i in range(6)] == wanted
    assert list(replay(rows).values()) == wanted


@pytest.mark.parametrize("age,inside", [(25 * 3600_000, False), (3600_000, True), (DAY_MS, False),
                                        (DAY_MS + 1, False), (DAY_MS - 1, True),
                                        (DAY_MS + 1000, False), (DAY_MS - 1000, True)])
def test_boundary_is_strict(spark, age, inside):
    now = 1_700_000_000_000
    assert lists(spark, [(1, 0, now - age), (1, 1, now)])[1, 1] == ([0, 1] if inside else [1])


def sample(seed, count, keys, spread):
    rng = random.Random(seed)
    tags, tag = [None] * rng.randint(0, 3), 0
    while len(tags) < count:
        tag += rng.choice([0, 0, rng.randint(1, spread)])
        tags.append(tag)
    # One key holds about a third of all batches.
    return [(rng.choice([0] * keys + list(range(2 * keys))), i, t) for i, t in enumerate(tags)]


@pytest.mark.parametrize("seed", range(3))
def test_lists_and_bounds_equal_a_replay(spark, seed):
    rows = sample(seed, 300, 4, 40)
    wanted = replay(rows, horizon=250)
    assert lists(spark, rows, 250) == wanted
    bounds = trailing_bounds(frame(spark, rows), 250).collect()
    assert len(bounds) == len(rows)
    for r in bounds:
        members = [i for k, i, _ in rows if k == r.k and r.after_batch_id < i <= r.batch_id]
        assert members == wanted[r.k, r.batch_id]


def test_times_must_not_fall(spark):
    with pytest.raises(Exception, match="arrival times fall"):
        trailing_bounds(frame(spark, [(1, 0, 50), (1, 1, 10), (1, 2, 60)]), 5).collect()


def test_stream_equals_replay_over_restarts(spark, tmp_path):
    rows = sample(9, 120, 3, 40)
    source, sink, tags, state = (str(tmp_path / name) for name in ("in", "out", "tags", "state"))
    for part in (rows[:1], rows[1:50], rows[50:51], rows[51:]):
        frame(spark, part).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame(spark, part).schema).parquet(source)
        trailing_bounds_stream(stream, sink, tags, state, 250, availableNow=True).awaitTermination()
    wanted = replay(rows, 250)
    got = spark.read.parquet(sink).collect()
    assert len(got) == len(rows)
    for r in got:
        members = [i for k, i, _ in rows if k == r.k and r.after_batch_id < i <= r.batch_id]
        assert members == wanted[r.k, r.batch_id]
    # Only what a later window can reach is kept, and only of the last two steps.
    kept = sorted(int(p.name) for p in (tmp_path / "tags").iterdir())
    assert len(kept) == 2
    last = spark.read.parquet(f"{tags}/{kept[-1]}")
    newest = max(t for *_, t in rows if t is not None)
    live = {t for *_, t in rows if t is not None and t > newest - 250}
    assert {r.t for r in last.collect()} - {None} <= live | {newest - 250}


@pytest.mark.parametrize("seed", range(2))
def test_counts_equal_the_members_of_chosen_windows(spark, seed):
    rows = sample(seed, 300, 4, 40)
    batches = frame(spark, rows)
    counted = window_counts(trailing_bounds(batches, 250), "k")
    got = {(r.k, r.batch_id): r.n_batches for r in counted.collect()}
    wanted = replay(rows, 250)
    assert got == {place: len(ids) for place, ids in wanted.items()}
    chosen = counted.filter(F.col("batch_id") % 50 == 0)
    members = window_members(chosen.select("k", "batch_id", "after_batch_id"), batches, "k", 16)
    for r in members.groupBy("k", "batch_id").count().collect():
        assert r["count"] == got[r.k, r.batch_id]


@pytest.mark.parametrize("seed,step", [(0, 1), (1, 7), (2, 64), (3, 1 << 10)])
def test_listed_windows_equal_a_replay(spark, seed, step):
    """Every window is listed whole, whatever the stretches of ids are."""
    rows = sample(seed, 300, 4, 40)
    bounds = trailing_bounds(frame(spark, rows), 250)
    got = {(r.k, r.batch_id): r.window_ids for r in window_lists(bounds, "k", step).collect()}
    wanted = replay(rows, 250)
    assert got == {place: ",".join(map(str, ids)) for place, ids in wanted.items()}


def test_windows_of_all_batches_are_listed(spark, tmp_path):
    """The query and its SQL give the members of each window, not only how many there are."""
    name = "q_trailing_day_batches"
    assert "window_ids" in ORACLES[name]
    folder = str(tmp_path)
    spark.range(1000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id * 4)").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit(1.5).alias("value"),
    ).write.parquet(f"{folder}/events.parquet")
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == 50 and max(r.n_batches for r in rows) > 3
    ids = {r.batch_id: r.station for r in rows}
    for r in rows:
        members = [i for i in sorted(ids) if ids[i] == r.station and r.after_batch_id < i <= r.batch_id]
        assert r.window_ids == ",".join(map(str, members)) and r.n_batches == len(members)


def test_windows_of_large_keys_are_not_counted(spark):
    bounds = spark.createDataFrame([(-1, 0, -1)], "k bigint, batch_id bigint, after_batch_id bigint")
    with pytest.raises(Exception, match="too large"):
        window_counts(bounds, "k").collect()


def stream_replay(spark, tmp_path, steps, horizon, restarts=()):
    """Windows of batches (key, id, event time in ms), one list of them per micro-batch."""
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = "k int, batch_id bigint, event_ts timestamp"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        run_available(trailing_windows_stream(stream, ["k"], horizon), sink, state)

    for number, rows in enumerate(steps):
        data = spark.createDataFrame(rows, "k int, batch_id bigint, at bigint").coalesce(1)
        data.select("k", "batch_id", F.timestamp_millis("at").alias("event_ts")).write.mode("append").parquet(source)
        if number in restarts or number == len(steps) - 1:
            run()
    return spark.read.parquet(sink).collect(), state


def windows_of(rows, steps):
    ids = {}
    for key, batch_id, _ in (row for step in steps for row in step):
        ids.setdefault(key, []).append(batch_id)
    return {(r.k, r.batch_id): [i for i in ids[r.k] if r.after_batch_id < i <= r.batch_id] for r in rows}


def test_known_case_by_the_engines_watermark(spark, tmp_path):
    """Event times that give the watermarks of the known case, one batch per micro-batch."""
    times = [*KNOWN[1:], 90_000_001]
    base = 1_700_000_000_000  # a watermark of zero would be none
    steps = [[(1, i, base + t)] for i, t in enumerate(times)]
    rows, _ = stream_replay(spark, tmp_path, steps, DAY_MS, restarts=(2,))
    got = windows_of(rows, steps)
    assert [got[1, i] for i in range(6)] == [[0], [1], [1, 2], [2, 3], [2, 3, 4], [3, 4, 5]]
    tags = {r.batch_id: None if r.arrival_ms is None else r.arrival_ms - base for r in rows}
    assert [tags[i] for i in range(6)] == KNOWN


def test_boundary_is_strict_by_the_engines_watermark(spark, tmp_path):
    now = 1_700_000_000_000
    for age, inside in ((DAY_MS - 1, True), (DAY_MS, False), (DAY_MS + 1, False)):
        steps = [[(1, 0, now - age)], [(1, 1, now)], [(1, 2, now)]]
        rows, _ = stream_replay(spark, tmp_path / str(age), steps, DAY_MS)
        assert windows_of(rows, steps)[1, 2] == ([1, 2] if inside else [2])


def test_many_batches_per_micro_batch_and_bounded_state(spark, tmp_path):
    rng = random.Random(3)
    base, steps, batch_id, newest = 1_700_000_000_000, [], 0, 1_700_000_000_000
    for _ in range(9):
        step = []
        for _ in range(rng.randint(1, 30)):
            newest += rng.choice([0, 0, 40])
            step.append((rng.choice([0, 0, 1, 2]), batch_id, newest))
            batch_id += 1
        steps.append(step)
    rows, state = stream_replay(spark, tmp_path, steps, 700, restarts=(3, 6))
    tagged, mark = [], None
    for step in steps:
        tagged += [(k, i, mark) for k, i, _ in step]
        mark = max([t for *_, t in step] + ([mark] if mark else []))
    assert windows_of(rows, steps) == replay(tagged, 700)
    assert len(rows) == batch_id
    kept = spark.read.format("statestore").option("stateVarName", "tags").load(state)
    tags = {r[0] for r in kept.select("user_map_key.tag").collect()}
    assert tags and all(tag > mark - 700 for tag in tags)
    assert min(t for *_, t in tagged if t) <= mark - 700
