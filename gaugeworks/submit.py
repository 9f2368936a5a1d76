"""The jobs for ``spark-submit``; ``--help`` lists them and their arguments.

    spark-submit --py-files gaugeworks.zip gaugeworks/submit.py windows-file s3a://bucket/lines
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from gaugeworks.plans import jobs
from gaugeworks.session import build_session
from gaugeworks.sinks.lines import line_sink, print_sink
from gaugeworks.sources.lines import stream_lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugeworks", description=__doc__.splitlines()[0])
    job = top.add_subparsers(dest="job", required=True)

    def add(name: str, text: str, *places: str) -> argparse.ArgumentParser:
        made = job.add_parser(name, help=text, description=text)
        for place in places:
            made.add_argument(place)
        return made

    batches = add("batches", "cut files into batches, parse them, print or store", "source")
    batches.add_argument("--kind", default="pms7003")
    batches.add_argument("--size", type=int, default=100)
    batches.add_argument("--seed", type=int)
    batches.add_argument("--sink", help="folder of parquet files; printed without it")
    file = add("windows-file", "average temperature per sensor and window of files", "source")
    file.add_argument("--duration", default="1 minute")
    file.add_argument("--sink", help="folder of text files; printed without it")
    file.add_argument("--mode", default="errorifexists")
    stream = add("windows-stream", "the same, following a folder", "source", "sink", "checkpoint")
    stream.add_argument("--duration", default="1 minute")
    stream.add_argument("--delay", default="0 seconds")
    stream.add_argument("--max-bytes", type=int, help="bytes a micro-batch takes at most")
    stream.add_argument("--once", action="store_true", help="stop when all that is there is done")
    add("latency-log", "latency log of result files", "results", "sink")
    add("latency-report", "summary and series of a latency log", "source", "sink")
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    asked = parser().parse_args(arguments)
    spark = build_session(f"gaugeworks {asked.job}")
    if asked.job == "batches":
        rows = jobs.batch_parse_job(spark, asked.source, asked.kind, asked.size, asked.seed)
        print_sink(rows) if asked.sink is None else rows.write.parquet(asked.sink)
    elif asked.job == "windows-file":
        results = jobs.windowed_temperature_file(spark, asked.source, asked.duration)
        if asked.sink is None:
            print_sink(results)
        else:
            line_sink(results, asked.sink, mode=asked.mode)
    elif asked.job == "windows-stream":
        limit = {"maxBytesPerTrigger": asked.max_bytes} if asked.max_bytes else {}
        lines = stream_lines(spark, asked.source, **limit)
        trigger = {"availableNow": True} if asked.once else {}
        jobs.windowed_temperature_stream(
            lines, asked.sink, asked.checkpoint, asked.duration, asked.delay, **trigger
        ).awaitTermination()
    elif asked.job == "latency-log":
        jobs.latency_log(spark, asked.results).select("value").write.text(asked.sink)
    else:
        report = jobs.latency_report(spark, asked.source)
        for name, frame in report.items():
            frame.write.parquet(f"{asked.sink}/{name}")


if __name__ == "__main__":
    main()
