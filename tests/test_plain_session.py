"""Queries in a session of Spark's own settings, started away from the repository."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = Path(entry_point.SMOKE_DIR)
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not here")

SCRIPT = """
import sys
repository, shared, tables, name, out = sys.argv[1:]
sys.path.insert(0, repository)
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.checkpoint.dir", shared)
    .getOrCreate()
)
from __spark_entry__ import queries
provider = "spark.sql.streaming.stateStore.providerClass"
before = spark.conf.get(provider, None)
queries()[name](spark, tables).toPandas().to_parquet(out)
assert spark.conf.get(provider, None) == before
spark.stop()
"""


@pytest.mark.parametrize("on_path", [True, False])
def test_windows_by_the_engines_watermark(tmp_path, on_path):
    """The RocksDB state store is not set up, nor, without ``on_path``, are the workers told of the package."""
    name, out = "q_stream_trailing_watermark", tmp_path / "out.parquet"
    repository = str(Path(entry_point.__file__).parent)
    env = {key: value for key, value in os.environ.items() if not key.startswith(("PYTHONPATH", "PYSPARK", "SPARK_"))}
    env["PYSPARK_PYTHON"] = sys.executable
    if on_path:
        env["PYTHONPATH"] = repository
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, repository, str(tmp_path / "shared"), str(TABLES), name, str(out)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert run.returncode == 0, run.stderr[-3000:]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{TABLES}/events.parquet'")
    columns = "station, batch_id, arrival_ms, after_batch_id"
    got = db.sql(f"SELECT {columns} FROM '{out}' ORDER BY batch_id").fetchall()
    assert got and got == db.sql(f"SELECT {columns} FROM ({entry_point.oracle_sql()[name]}) ORDER BY batch_id").fetchall()
