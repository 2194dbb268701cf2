"""Sessions that did not start from the library's folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver does, whatever folder they start in. On a cluster the
    package is installed on every machine, or shipped with ``--py-files``; then this changes nothing."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    return spark
