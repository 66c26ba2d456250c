"""The session that bench, tests and examples use; operators take any session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(cores: str | int = "*", app: str = "sigspark", **conf: str) -> SparkSession:
    """A local session with UTC, AQE and Arrow on; ``conf`` overrides (underscores stand for dots)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
