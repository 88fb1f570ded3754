"""The package itself for Python workers that don't have it on their path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package to the session's workers, once per context; Spark copies it to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ledgerloom-')}/ledgerloom", "zip", package.parent, package.name)
    sc.addPyFile(made)
    sc._ledgerloom_shipped = True
