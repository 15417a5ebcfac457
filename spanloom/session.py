"""A local session for tests and benches; on a cluster use its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("spanloom").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
