"""What a session needs before Python workers run functions of this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed on them."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{_ROOT}:{paths}" if paths else _ROOT
    return spark
