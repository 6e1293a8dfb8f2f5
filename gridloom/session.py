"""Making the package importable on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context.

    Python tasks import it; where it is installed or on PYTHONPATH this changes nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="gridloom-"))
    sc.addPyFile(shutil.make_archive(f"{folder}/gridloom", "zip", root_dir=root, base_dir="gridloom"))
    sc._gridloom_shipped = True
