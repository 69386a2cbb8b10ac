"""Session settings that the engine's operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tablesense", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; on a cluster leave ``master`` to the launcher."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return shipped(builder.config(map=SETTINGS | settings).getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers find this package where it lies, whatever folder they were started in. On a cluster
    without a common file system the package goes along with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
