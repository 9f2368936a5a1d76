"""Session settings the library is meant to run under, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many small batch ids per task: keep collect_list in the hash aggregate.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Window state for many sensors belongs off-heap and on disk.
    STATE_PROVIDER: ROCKSDB_STATE,
}


def build_session(app: str = "gaugeworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="gaugeworks-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in ``spark.checkpoint.dir``.

    A machine-local folder is only ever used when the session itself is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return _local_folder(spark.sparkContext.applicationId)
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


RUN_FOLDER = "spark.gaugeworks.runFolder"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the current run's folder in it."""
    folder = spark.conf.get(RUN_FOLDER, None) or shared_folder(spark)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Collect all tables that steps write meanwhile in one folder and remove it at the end.

    Results that read such tables must be written or counted inside.
    """
    path = scratch_path(spark, name)
    before = spark.conf.get(RUN_FOLDER, None)
    spark.conf.set(RUN_FOLDER, path)
    try:
        yield path
    finally:
        spark.conf.set(RUN_FOLDER, before) if before else spark.conf.unset(RUN_FOLDER)
        _delete(spark, path)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, whatever the session is set to.

    A stream takes the setting when it starts and keeps it over restarts.
    """
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB_STATE)
    try:
        yield
    finally:
        spark.conf.set(STATE_PROVIDER, before) if before else spark.conf.unset(STATE_PROVIDER)


# Shuffle files go when their query ends, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(frame: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For tables that several later steps use: they are computed once, survive lost executors, their
    size is known when the joins with them are planned, and the shuffles that made them are
    deleted at once. ``forget`` deletes the table itself.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    settled = spark.read.schema(frame.schema).parquet(path)
    settled.settled_path = path
    return settled


def in_rounds(
    frame: DataFrame, key: str, rounds: int, step: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """One settled table of what ``step`` settles for each part of the frame, dealt out by ``key``.

    For steps whose shuffles are far larger than their results: the disk holds those of one part.
    """
    if rounds <= 1:
        return step(frame)
    part = F.pmod(F.xxhash64(key), F.lit(rounds))
    done = [step(frame.filter(part == k)) for k in range(rounds)]
    whole = settle(reduce(DataFrame.union, done), "rounds")
    forget(*done)
    return whole


def forget(*frames: DataFrame) -> None:
    """Delete tables that ``settle`` returned, once nothing reads them any more."""
    for frame in frames:
        _delete(frame.sparkSession, frame.settled_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
