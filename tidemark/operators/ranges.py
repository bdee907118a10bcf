"""Cutting a sorted table into pieces of like size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import scratch_path


def cut_in_ranges(df: DataFrame, *by: Column) -> DataFrame:
    """Add ``_range``, a number that rises with ``by``: equal rows share a range, no range is much larger than others.

    Split points come from a sample of all rows, so that a large group spans many ranges whatever its values
    look like. There are as many ranges as shuffle partitions. The table is written once to the shared scratch
    folder, since sampling again need not cut at the same places.
    """
    session = df.sparkSession
    ranges = int(session.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(session, "ranges")
    df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return session.read.parquet(path)
