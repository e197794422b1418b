"""A session with the settings that the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "radquery", **conf: str) -> SparkSession:
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
