"""Writing tables: plain modes, validated publishing, snapshots, history as intervals.

A path that a plan may read is never overwritten: each write has a folder of its own, and the table's commits say which
folders count. A folder that no commit names was left by a run that did not get to its end. Of two writers that start
from the same version one gets ``Conflict`` and may try again; see ``commits`` for that and for the clean-up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.spread import null_safe
from tidemark.sources import commits

MODES = ("overwrite", "append", "create_if_absent")


def read_pointer(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    """The pointer table, or None before the first row of it was written."""
    return spark.read.schema(schema).parquet(f"{root}/pointer") if commits.names(spark, f"{root}/pointer") else None


def point(spark: SparkSession, root: str, schema: str, *row) -> None:
    """Add a row to the pointer table: from now on it counts."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def published_version(spark: SparkSession, root: str) -> int | None:
    """The version in force, or None before the first one was published."""
    last = commits.latest(spark, root)
    return None if last is None else last[1]["version"]


def _folders(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """All rows of the folders that an entry names; they are written with one schema each, read with the last one's."""
    schema = T.StructType.fromJson(entry["schema"])
    return spark.read.schema(schema).parquet(*[f"{root}/{folder}" for folder in entry["folders"]])


def published(spark: SparkSession, root: str) -> DataFrame:
    last = commits.latest(spark, root)
    if last is None:
        raise ValueError(f"nothing published yet at {root}")
    return _folders(spark, root, last[1])


def write_table(df: DataFrame, root: str, mode: str) -> DataFrame:
    """Write and read back. ``overwrite`` writes a new version beside the old one, which may be what ``df`` reads;
    ``append`` writes a folder that counts beside those in force from the commit on, so that readers never see a part of
    it; ``create_if_absent`` leaves a table that exists as it is.

    An appended frame has to have the table's columns. Raises ``commits.Conflict`` if another writer was first.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    spark = df.sparkSession
    last = commits.latest(spark, root)
    if last is None or mode != "create_if_absent":
        number, entry = last or (-1, {"version": -1, "folders": []})
        earlier = entry["folders"] if mode == "append" else []
        if earlier:
            there = T.StructType.fromJson(entry["schema"])
            if {(f.name, f.dataType) for f in there} != {(f.name, f.dataType) for f in df.schema}:
                raise ValueError(f"the table has columns {there.simpleString()}, not {df.schema.simpleString()}")
        folder = commits.new_folder()
        df.write.parquet(f"{root}/{folder}")
        schema = entry["schema"] if earlier else df.schema.jsonValue()
        commits.commit(spark, root, number + 1, {"version": entry["version"] + 1, "folders": [*earlier, folder], "schema": schema})
    return published(spark, root)


def validated_publish(df: DataFrame, rules: Mapping[str, Column], root: str, version: int) -> DataFrame:
    """Write a candidate, counting broken rules on the way, and let it count only if every row keeps every rule.

    Rows are counted as they are written, so the candidate is not read before it is published. Otherwise the previous
    version stays in force; the candidate's folder stays until a clean-up. A version not above the one in force was
    already dealt with (a replay) and is not written again. Returns the version in force.
    """
    spark = df.sparkSession
    number, entry = commits.latest(spark, root) or (-1, {"version": None})
    if entry["version"] is None or version > entry["version"]:
        kept = F.lit(True)
        for rule in rules.values():
            kept = kept & F.coalesce(rule, F.lit(False))
        folder, seen = commits.new_folder(), Observation()
        df.observe(seen, F.count_if(~kept).alias("broken")).write.parquet(f"{root}/{folder}")
        # a task that was run again may count a row twice, but never a row that is not broken
        if seen.get["broken"] == 0:
            commits.commit(spark, root, number + 1, {"version": version, "folders": [folder], "schema": df.schema.jsonValue()})
    return published(spark, root)


STATES = "snapshot_ts bigint, version bigint"


def snapshot_history(df: DataFrame, root: str, ts: int) -> DataFrame:
    """Keep ``df`` as the state at epoch second ``ts`` beside all other states; returns the history.

    A state written again replaces the one of the same ``ts``, in a folder of its own. One writer at a time.
    """
    spark = df.sparkSession
    pointer = read_pointer(spark, root, STATES)
    last = pointer.agg(F.max("version")).first()[0] if pointer is not None else None
    version = 0 if last is None else last + 1
    df.write.mode("overwrite").parquet(f"{root}/data/snapshot_ts={ts}/v={version}")
    point(spark, root, STATES, ts, version)
    return history(spark, root)


def history(spark: SparkSession, root: str) -> DataFrame:
    """All states with their ``snapshot_ts`` (bigint); reading some of them lists and reads only these."""
    pointer = read_pointer(spark, root, STATES)
    if pointer is None:
        raise ValueError(f"no state kept yet at {root}")
    counting = pointer.groupBy("snapshot_ts").agg(F.max("version").alias("version")).collect()  # a row per state
    paths = [f"{root}/data/snapshot_ts={row.snapshot_ts}/v={row.version}" for row in counting]
    states = spark.read.option("basePath", f"{root}/data").parquet(*paths).drop("v")
    return states.withColumn("snapshot_ts", F.col("snapshot_ts").cast("bigint"))


def snapshot_latest(history: DataFrame, as_of: int, ts: str = "snapshot_ts") -> DataFrame:
    """The whole latest state at or before ``as_of``; other partitions are not read."""
    latest = history.where(F.col(ts) <= as_of).agg(F.max(ts).alias("latest"))
    return history.where(F.col(ts) == latest.scalar())


def interval_history(df: DataFrame, root: str, key: Sequence[str], ts: int) -> DataFrame:
    """Keep ``df``, unique by ``key``, as the state from epoch second ``ts`` on; returns all rows with their intervals.

    A row counts from ``valid_from`` until before ``valid_to`` (null: it still does). A row that is as it was keeps its
    interval; one that was changed or is missing gets its end, and a changed or new one opens an interval. So a state
    costs the rows that differ, beside the rows in force, which are written anew; ended rows are written once. A null is
    a key like any other. States come in order: ``ts`` has to be above the last one. Raises ``commits.Conflict`` if
    another writer was first.
    """
    spark = df.sparkSession
    columns = df.columns
    number, entry = commits.latest(spark, root) or (-1, None)
    open_schema = T.StructType([*df.schema.fields, T.StructField("valid_from", T.LongType())])
    if entry is None:
        ended, now = [], df.withColumn("valid_from", F.lit(ts).cast("long"))
    else:
        if ts <= entry["ts"]:
            raise ValueError(f"the last state is of {entry['ts']}, this one of {ts}")
        if T.StructType.fromJson(entry["schema"]).fieldNames() != columns:
            raise ValueError(f"the states have columns {T.StructType.fromJson(entry['schema']).fieldNames()}")
        there = spark.read.schema(open_schema).parquet(f"{root}/{entry['open']}")
        rest = [c for c in columns if c not in key]
        s, t = df.withColumn("_in", F.lit(True)).alias("s"), there.withColumn("_in", F.lit(True)).alias("t")
        both = s.join(t, null_safe("s", "t", key), "full_outer")
        alike = F.col("s._in").isNotNull() & F.col("t._in").isNotNull() & null_safe("s", "t", rest)
        alike = F.coalesce(alike, F.lit(False))
        stays = F.when(alike, F.col("t.valid_from")).otherwise(F.lit(ts).cast("long")).alias("valid_from")
        now = both.where("s._in").select(*[F.col(f"s.{c}") for c in columns], stays)
        gone = both.where(F.col("t._in") & ~alike).select(
            *[F.col(f"t.{c}") for c in columns], "t.valid_from", F.lit(ts).cast("long").alias("valid_to")
        )
        folder = commits.new_folder()
        gone.write.parquet(f"{root}/{folder}")
        ended = [*entry["ended"], folder]
    folder = commits.new_folder()
    now.write.parquet(f"{root}/{folder}")
    said = {"folders": [folder, *ended], "open": folder, "ended": ended, "ts": ts, "schema": df.schema.jsonValue()}
    commits.commit(spark, root, number + 1, said)
    return intervals(spark, root)


def intervals(spark: SparkSession, root: str) -> DataFrame:
    """All rows that ever counted, with ``valid_from`` and ``valid_to``."""
    last = commits.latest(spark, root)
    if last is None:
        raise ValueError(f"no state kept yet at {root}")
    entry = last[1]
    fields = [*T.StructType.fromJson(entry["schema"]).fields, T.StructField("valid_from", T.LongType())]
    now = spark.read.schema(T.StructType(fields)).parquet(f"{root}/{entry['open']}").withColumn("valid_to", F.lit(None).cast("long"))
    if not entry["ended"]:
        return now
    schema = T.StructType([*fields, T.StructField("valid_to", T.LongType())])
    return now.unionByName(spark.read.schema(schema).parquet(*[f"{root}/{folder}" for folder in entry["ended"]]))


def state_as_of(intervals: DataFrame, ts: int) -> DataFrame:
    """The state at epoch second ``ts``: one filter, pushed to the files. Before the first state it is empty."""
    counts = (F.col("valid_from") <= ts) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts))
    return intervals.where(counts).drop("valid_from", "valid_to")
