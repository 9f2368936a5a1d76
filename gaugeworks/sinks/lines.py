"""Line and console sinks for tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery


def _text(row: Row) -> str:
    return row["line"] if "line" in row.asDict() else ", ".join(map(str, row))


def print_sink(
    results: DataFrame,
    emit: Callable[[str], None] = print,
    emit_all: Callable[[Iterable[str]], None] | None = None,
) -> StreamingQuery | None:
    """Print every result, one text line each, on the executor that holds it.

    The text is the ``line`` column, or all columns without one. ``emit`` takes the text in place
    of ``print``; for a table ``emit_all`` may take all texts of a partition instead. A stream prints
    each result once per attempt.
    """
    if results.isStreaming:
        return results.writeStream.foreach(lambda row: emit(_text(row))).outputMode("append").start()

    def print_all(rows: Iterable[Row]) -> None:
        if emit_all is not None:
            return emit_all(map(_text, rows))
        for row in rows:
            emit(_text(row))

    results.foreachPartition(print_all)
    return None


def line_sink(
    results: DataFrame,
    path: str | None,
    checkpoint: str | None = None,
    fmt: str = "text",
    mode: str = "errorifexists",
    options: dict[str, str] | None = None,
    **trigger,
) -> StreamingQuery | None:
    """Write the ``line`` column, as column ``value``, one record per result.

    Text files are the default; any other writer works through ``fmt`` and ``options``, with no
    ``path`` where it needs none. A table is written once: ``mode`` says what happens when the
    job runs again. A stream appends each result exactly once to files; ``checkpoint`` is required
    and ``trigger`` takes the arguments of ``DataStreamWriter.trigger``.
    """
    lines = results.selectExpr("line AS value")
    if not results.isStreaming:
        writer = lines.write.format(fmt).options(**(options or {})).mode(mode)
        writer.save(path) if path is not None else writer.save()
        return None
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder")
    stream = lines.writeStream.format(fmt).options(**(options or {})).outputMode("append")
    stream = stream.option("checkpointLocation", checkpoint)
    if trigger:
        stream = stream.trigger(**trigger)
    return stream.start(path) if path is not None else stream.start()
