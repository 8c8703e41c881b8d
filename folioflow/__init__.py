"""Spark-native analytics of document-job metadata."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session find the package where it is not installed."""
    held = spark.sparkContext.environment
    known = held.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        held["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, *known) if x)
    return spark
