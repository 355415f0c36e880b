"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach_workers(spark: SparkSession) -> None:
    """Adds the package's folder to the path that the session gives to its Python workers.

    The folder must be visible to the executors; where it isn't, submit the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, path) if p)
