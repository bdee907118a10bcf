"""A keyed table in hash buckets, each in a folder of its own version; a commit names the folder of every bucket.

A change rewrites the buckets that it touches and no others. A commit is one step, so that readers see all buckets as
they were at one time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sync import sync_apply
from tidemark.sources import commits

BUCKETS = 64


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """Number of a key's bucket; a null is a key like any other."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, root: str, key: Sequence[str], buckets: int) -> dict[str, str]:
    """Write buckets below a new folder, each by one task; returns the folders of those that have rows."""
    folder = commits.new_folder()
    numbered = df.withColumn("_bucket", bucket_of(key, buckets)).repartition("_bucket")
    numbered.write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    return {name.removeprefix("_bucket="): f"{folder}/{name}" for name in commits.names(df.sparkSession, f"{root}/{folder}") if "=" in name}


def _said(entry: dict, folders: dict[str, str], **more) -> dict:
    return entry | {"buckets": folders, "folders": sorted(folders.values())} | more


def start_buckets(df: DataFrame, root: str, key: Sequence[str], buckets: int = BUCKETS, **more) -> None:
    """Write a first version, unique by ``key``. A bucket should come to some hundred MB; their number stays. ``more`` is
    kept in the commit."""
    if "_bucket" in df.columns:
        raise ValueError("_bucket is the name of the column that the folders have")
    entry = {"key": list(key), "count": buckets, "schema": df.schema.jsonValue()}
    commits.commit(df.sparkSession, root, 0, _said(entry, _write(df, root, key, buckets), **more))


def bucketed(spark: SparkSession, root: str, only: Sequence[int] | None = None) -> tuple[DataFrame, int, dict]:
    """The table, or some buckets of it, with the commit's number and entry."""
    last = commits.latest(spark, root)
    if last is None:
        raise ValueError(f"nothing published yet at {root}")
    number, entry = last
    named = entry["buckets"] if only is None else {str(b): entry["buckets"][str(b)] for b in only if str(b) in entry["buckets"]}
    return _read(spark, root, entry, named), number, entry


def _read(spark: SparkSession, root: str, entry: dict, named: dict[str, str]) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    if not named:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{folder}" for folder in named.values()])


def upsert(changes: DataFrame, root: str, **more) -> list[int]:
    """Rows of ``changes``, unique by the table's key, replace those of their keys or come in addition.

    Returns the buckets that were rewritten; all others stay as they are. Raises ``commits.Conflict`` if another writer
    was first: nothing of this call counts then, and it can be made again.
    """
    spark = changes.sparkSession
    last = commits.latest(spark, root)
    if last is None:
        raise ValueError(f"nothing published yet at {root}")
    number, entry = last
    key, buckets = entry["key"], entry["count"]
    # at most a number per bucket
    touched = sorted(row[0] for row in changes.select(bucket_of(key, buckets)).distinct().collect())
    there = _read(spark, root, entry, {str(b): entry["buckets"][str(b)] for b in touched if str(b) in entry["buckets"]})
    folders = _write(sync_apply(changes, there, key, "additive"), root, key, buckets) if touched else {}
    commits.commit(spark, root, number + 1, _said(entry, entry["buckets"] | folders, **more))
    return touched
