"""Task statistics out of Spark's own event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the names Spark gives these fields
TASK_END = "SparkListenerTaskEnd"
SCHEMA = """
    `Event` string,
    `Stage ID` bigint,
    `Stage Attempt ID` bigint,
    `Task Info` struct<`Failed`: boolean>,
    `Task Metrics` struct<
        `Executor Run Time`: bigint,
        `Memory Bytes Spilled`: bigint,
        `Disk Bytes Spilled`: bigint,
        `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint>,
        `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>
"""


def event_log_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Per (app, stage, attempt): tasks, failures, run time, skew, shuffle and spill, from all logs under ``path``.

    A stage that was run again is an attempt of its own, numbered from 0. Plain, rolled and compressed logs are read alike. The application comes from the file's name, or
    from a folder ``app=<id>`` for logs stored by application.
    """
    lines = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(path)
    file = F.col("_metadata.file_path")
    app = F.coalesce(
        F.nullif(F.regexp_extract(file, "/(?:app=|eventlog_v2_)([^/]+)/[^/]*$", 1), F.lit("")),
        F.regexp_extract(file, r"([^/]+?)(?:[.](?:zstd|lz4|lzf|snappy))?(?:[.]inprogress)?$", 1),
    )
    metrics = F.col("`Task Metrics`")
    read = metrics["Shuffle Read Metrics"]
    tasks = lines.where(F.col("Event") == TASK_END).select(
        # Spark gives paths as URIs
        F.url_decode(F.replace(app, F.lit("+"), F.lit("%2B"))).alias("app"),
        F.col("`Stage ID`").alias("stage"),
        F.coalesce("`Stage Attempt ID`", F.lit(0)).alias("attempt"),
        F.col("`Task Info`")["Failed"].alias("failed"),
        metrics["Executor Run Time"].alias("run"),
        (read["Remote Bytes Read"] + read["Local Bytes Read"]).alias("read"),
        metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"].alias("written"),
        (metrics["Memory Bytes Spilled"] + metrics["Disk Bytes Spilled"]).alias("spilled"),
    )
    rolled = tasks.groupBy("app", "stage", "attempt").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("failed").alias("failed"),
        F.percentile_approx("run", [0.5, 0.95]).alias("_run"),
        F.max("run").alias("run_max"),
        F.coalesce(F.sum("read"), F.lit(0)).alias("shuffle_read"),
        F.coalesce(F.sum("written"), F.lit(0)).alias("shuffle_write"),
        F.coalesce(F.sum("spilled"), F.lit(0)).alias("spilled"),
    )
    p50, p95 = F.col("_run")[0], F.col("_run")[1]
    return rolled.select(
        "app",
        "stage",
        "attempt",
        "tasks",
        "failed",
        p50.alias("run_p50"),
        p95.alias("run_p95"),
        "run_max",
        F.when(p50 > 0, F.col("run_max") / p50).alias("skew"),
        "shuffle_read",
        "shuffle_write",
        "spilled",
    )
