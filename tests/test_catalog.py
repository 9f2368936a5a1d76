"""Every catalog query against its SQL on the smallest tables, and the shape of key plans."""

import io
import re
from contextlib import redirect_stdout
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from check_queries import normal
from gaugeworks.plans.catalog import QUERIES
from gaugeworks.plans.catalog_sql import ORACLES

TABLES = Path(entry_point.SMOKE_DIR)
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    got = normal(QUERIES[name](spark, str(TABLES)).toPandas())
    assert got == normal(db.sql(ORACLES[name]).df())
    assert got


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())


def explained(frame, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


def test_flagship_plan(spark):
    plan = explained(entry_point.entry(spark))
    assert plan.count("Exchange (") == 1
    assert "partial_avg" in plan and "Python" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


@pytest.mark.parametrize("kind", ["base", "pms7003", "bmp280", "bme280"])
def test_parsing_fits_the_compiler(spark, kind):
    """The JVM leaves methods beyond 8000 bytes uncompiled."""
    from gaugeworks.operators.parsing import parse_readings

    lines = spark.range(1).selectExpr("cast(id as string) as value")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", explained(parse_readings(lines, kind), "codegen"))
    assert sizes and max(map(int, sizes)) < 8000


def test_filters_stay_above_the_split(spark):
    plan = explained(entry_point.entry(spark))
    assert plan.count("split(") <= 2
