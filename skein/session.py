"""Session helper for tests, benches and local use; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    return SparkSession.builder.master(f"local[{cores}]").appName("skein").config(map=conf).getOrCreate()
