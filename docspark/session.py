"""What a session needs to run the package's functions in tasks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    Where executors have it installed or on their path anyway, this changes nothing.
    """
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
