"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Let Python workers of this session get no more than ROWS_PER_BATCH rows at a time: texts can be long, and
    workers stay alive with what memory their largest batch took."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if not 0 < now <= ROWS_PER_BATCH:
        spark.conf.set(setting, ROWS_PER_BATCH)


def whole(text: Column) -> Column:
    """A text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ordered(df: DataFrame, *by: Column) -> DataFrame:
    """Cut into ranges of ``by``: adds ``_range``, which rises with the order; equal rows share a range.

    Ranges are balanced by a sample of all rows, so that no key is too large for one task. Written once,
    since another run of the sampling need not cut at the same places.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id())
    return written(cut, "ordered")


def with_ids(docs: DataFrame, key: str) -> DataFrame:
    """Add ``_id``, a long that tells rows apart: the key if it is an integer of which no two rows have the same,
    else a number given to the rows, which are then written first so that it does not change."""
    if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        rows, known, distinct = docs.agg(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
        if rows == known == distinct:
            return docs.withColumn("_id", F.col(key).cast("long"))
    return written(docs.withColumn("_id", F.monotonically_increasing_id()), "numbered")
