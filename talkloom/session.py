"""Spark sessions for tests and single machines; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", more: dict[str, str] | None = None) -> SparkSession:
    conf = {
        "spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(cores), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true",
    }
    spark = SparkSession.builder.config(map=conf | (more or {})).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
