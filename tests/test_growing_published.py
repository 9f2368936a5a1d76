"""Files that grow, a target with a two-step commit, and numbers that survive another packing."""

import os
import random
import shutil

import pyarrow as pa
import pytest

from gaugeworks.sinks.lines import line_sink, print_sink
from gaugeworks.sinks.published import (
    PublishedLines,
    Staged,
    publish,
    read_published,
    remove_unpublished,
    stage,
    use_published,
)
from gaugeworks.sources.growing import ByteRange, GrowingReader, growing_lines
from gaugeworks.sources.lines import stream_lines
from gaugeworks.sources.numbered import number_file_lines
from gaugeworks.streaming.runs import run_available


def append(path, text):
    with open(path, "ab") as file:
        file.write(text if isinstance(text, bytes) else text.encode())


def test_appended_lines_are_read_once(spark, tmp_path):
    folder, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    one, two = tmp_path / "in" / "a.log", tmp_path / "in" / "deep" / "b.log"

    def run():
        run_available(growing_lines(spark, folder), sink, state)
        return sorted(r.value for r in spark.read.parquet(sink).collect())

    append(one, "first\nsecond\nhal")
    assert run() == ["first", "second"]  # half a line waits
    append(one, "f\r\n\n")
    append(two, "other\n")
    append(tmp_path / "in" / "_hidden", "no\n")
    assert run() == sorted(["first", "second", "half", "", "other"])
    assert run() == sorted(["first", "second", "half", "", "other"])  # nothing new
    append(two, "no end")
    append(one, "é漢\nlast\n")
    assert run() == sorted(["first", "second", "half", "", "other", "é漢", "last"])
    append(two, " but now\n")
    assert run()[-1] == "é漢" and "no end but now" in run()


def test_a_folder_that_is_not_there_yet(spark, tmp_path):
    folder, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    run_available(growing_lines(spark, folder), sink, state)
    (tmp_path / "in").mkdir()
    append(tmp_path / "in" / "a", "x\n")
    run_available(growing_lines(spark, folder), sink, state)
    assert [r.value for r in spark.read.parquet(sink).collect()] == ["x"]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
def test_ranges_give_every_line_once(tmp_path, size):
    rng = random.Random(size)
    lines = ["y" * rng.choice([0, 1, 5, 200]) for _ in range(300)] + ["z" * 100_000, "end"]
    file = tmp_path / "f"
    file.write_text("\n".join(lines) + "\n" + "half")
    reader = GrowingReader(str(tmp_path), size if size > 64 else 64 * size)
    end = reader.latestOffset()
    assert end == {str(file): os.path.getsize(file) - 4}
    got = [
        text
        for part in reader.partitions({}, end)
        for batch in reader.read(part)
        for text in batch.column(0).to_pylist()
    ]
    assert got == lines
    middle = len("\n".join(lines[:40])) + 1
    parts = reader.partitions({str(file): middle}, end)
    got = [t for part in parts for b in reader.read(part) for t in b.column(0).to_pylist()]
    assert got == lines[40:]
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions({str(file): 10**9}, end)


def test_a_range_within_one_line_is_empty(tmp_path):
    (tmp_path / "f").write_text("a" * 1000 + "\nb\n")
    reader = GrowingReader(str(tmp_path))
    assert list(reader.read(ByteRange(str(tmp_path / "f"), 10, 500, 0))) == []


def batch(*texts):
    return [pa.RecordBatch.from_arrays([pa.array(texts)], names=["value"])]


def test_a_failed_task_and_a_repeated_batch_leave_no_double_line(spark, tmp_path):
    path = str(tmp_path / "target")
    writer = PublishedLines({"path": path}).streamWriter(None, False)

    def broken():
        yield from batch("a", "b")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stage(path, broken())  # a task that dies half way
    first = [writer.write(iter(batch("a", "b"))), writer.write(iter(batch("c"))), None]
    assert isinstance(first[0], Staged) and first[0].records == 2
    assert read_published(spark, path).count() == 0  # staged is not published
    writer.commit(first, 0)
    again = [writer.write(iter(batch("c", "a", "b")))]  # dealt to tasks otherwise
    writer.commit(again, 0)
    given_up = [writer.write(iter(batch("zzz")))]
    writer.abort(given_up, 1)
    writer.commit([writer.write(iter(batch("d")))], 1)
    assert sorted(r.value for r in read_published(spark, path).collect()) == ["a", "b", "c", "d"]
    assert remove_unpublished(spark, path) == 1  # what the dead task left
    assert read_published(spark, path).count() == 4
    assert publish(path, "batch-1", []) is False


def test_a_stream_that_repeats_a_micro_batch(spark, tmp_path):
    """The driver dies between the target's commit and the checkpoint's."""
    source, target, state = (str(tmp_path / name) for name in ("in", "target", "state"))
    options = {"fmt": use_published(spark), "options": {"path": target}, "availableNow": True}
    (tmp_path / "in").mkdir()
    for number in range(3):
        (tmp_path / "in" / f"f{number}.txt").write_text(f"{number}a\n{number}b\n")
        os.utime(tmp_path / "in" / f"f{number}.txt", (1_700_000_000 + number,) * 2)
        lines = stream_lines(spark, source).selectExpr("value AS line")
        line_sink(lines, None, state, **options).awaitTermination()
        if number == 1:
            for name in ("1", ".1.crc"):
                (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    rows = read_published(spark, target).collect()
    assert sorted(r.value for r in rows) == ["0a", "0b", "1a", "1b", "2a", "2b"]
    assert len({r.batch for r in rows}) == 3


def test_tables_are_published_too(spark, tmp_path):
    target = str(tmp_path / "target")
    lines = spark.range(100).selectExpr("concat('row ', id) AS line").repartition(4)
    options = {"path": target, "run": "monday"}
    line_sink(lines, None, fmt=use_published(spark), mode="append", options=options)
    line_sink(lines, None, fmt=use_published(spark), mode="append", options=options)  # the job runs again
    rows = read_published(spark, target)
    assert rows.count() == 100 and rows.select("batch").distinct().count() == 1


def test_all_texts_of_a_partition_at_once(spark, tmp_path):
    folder = str(tmp_path)

    def keep(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.writelines(f"{text}\n" for text in texts)

    print_sink(spark.range(30).selectExpr("id", "id + 1 AS more").repartition(3), emit_all=keep)
    got = sorted(text for file in tmp_path.iterdir() for text in file.read_text().split("\n") if text)
    assert got == sorted(f"{k}, {k + 1}" for k in range(30))


@pytest.mark.parametrize("before,after", [(4, 16), (16, 4), (1, 40), (4, 4)])
def test_numbers_survive_another_packing_of_splits(spark, tmp_path, before, after):
    """The files are dealt to tasks otherwise between planning the numbers and reading them."""
    folder = tmp_path / "in"
    folder.mkdir()
    for number in range(3):
        (folder / f"f{number}").write_text("header\n" + "".join(f"{number};{k}\n" for k in range(20_000)))
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(names[1], "64k")
        spark.conf.set(names[0], str(before))
        numbered = number_file_lines(spark, str(folder))
        spark.conf.set(names[0], str(after))
        spark.conf.set(names[1], "100k")
        rows = numbered.selectExpr("n", "total", "value").collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    wanted = [f"{number};{k}" for number in range(3) for k in range(20_000)]
    assert [r.value for r in sorted(rows)] == wanted
    assert [r.n for r in sorted(rows)] == list(range(60_000)) and {r.total for r in rows} == {60_000}
    shutil.rmtree(folder)
