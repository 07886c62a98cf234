"""A session with the settings the library's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC and adaptive execution; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
