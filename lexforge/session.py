"""Spark sessions with the settings that the engine's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lexforge", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times. On a cluster, master and memory come from the submit command."""
    b = SparkSession.builder.appName(name)
    if not SparkSession.getActiveSession():
        b = b.master(f"local[{cores}]")
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
