"""The package's own code for the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


@lru_cache(maxsize=8)
def _ship(application: str) -> str:
    from pyspark import SparkContext

    root = Path(__file__).resolve().parents[1]
    staged = Path(tempfile.mkdtemp(prefix="sluice-code-"))
    shutil.copytree(root, staged / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    made = shutil.make_archive(str(staged / root.name), "zip", staged / "code")
    SparkContext.getOrCreate().addPyFile(made)
    return made


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once an application."""
    _ship(spark.sparkContext.applicationId)
