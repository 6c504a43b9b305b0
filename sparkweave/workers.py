"""How Python workers come by this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers that share this file system import this package from where it lies.

    A cluster that doesn't share it gets the package with ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
