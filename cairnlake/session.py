"""Session settings that the operators count on: UTC and ANSI arithmetic, adaptive plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cairnlake", **conf: str) -> SparkSession:
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
