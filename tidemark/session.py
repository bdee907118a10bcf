"""Session settings for local runs (bench and tests). On a cluster the caller brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int, name: str = "tidemark") -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # the same two settings a benchmark cluster turns off, so runs compare
        .config("spark.dynamicAllocation.enabled", "false")
        .config("spark.speculation", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
