"""Spark session factory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "tidewater", **conf: str) -> SparkSession:
    """A session with ANSI semantics, adaptive execution and UTC; sizes stay with the cluster unless given."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    if master or "MASTER" in os.environ:
        builder = builder.master(master or os.environ["MASTER"])
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
