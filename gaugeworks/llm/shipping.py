"""Sends this package to the executors, whose batch functions import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import gaugeworks

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the Python path of all tasks of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(gaugeworks.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="gaugeworks-py-")) / "gaugeworks.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, Path("gaugeworks") / module.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
