"""The package on executors that do not have it installed."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to all Python workers of this application, those to come included. Needed where it is neither
    installed on the cluster nor on the workers' PYTHONPATH."""
    package = pathlib.Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)  # copied to the driver's file server at once
