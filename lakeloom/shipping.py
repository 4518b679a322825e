"""Sends this package to executors, which may not have it, once for each application."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    package = Path(__file__).resolve().parent
    if spark.sparkContext.applicationId not in _SHIPPED and package.is_dir():
        name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lakeloom-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(spark.sparkContext.applicationId)
