import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from gaugeworks.llm.shipping import ship_package  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus():
    return brute.corpus()


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of given rows, with extra columns of clashing names."""
    ship_package(spark)

    def build(rows, parts=3):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        return frame.withColumns({name: F.lit(-1) for name in brute.CLASHING})

    return build
