"""Incremental forms of ``insert_if_absent`` and ``sync_apply``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.spread import null_safe
from tidemark.operators.sync import insert_if_absent, sync_apply
from tidemark.sources import buckets, commits


def stream_insert_if_absent(
    stream: DataFrame,
    key: Sequence[str],
    spread_by: Sequence[str],
    existing: DataFrame | None = None,
    shares: int = 16,
) -> DataFrame:
    """Let the first row of each key through and drop all later ones, and all whose key ``existing`` has.

    Exact however late a row comes: the state holds every key that passed. ``stream_insert_within_delay`` has a
    bounded state and puts late rows aside; or start a new query from time to time with what was inserted so far
    as ``existing``.

    Rows are dropped in two stages, first within a share of each key's rows, then by key: however
    frequent a key is, no task gets more than its share, and at most ``shares`` rows of it go on. The
    state of the first stage grows with ``shares`` for keys that are repeated often.
    """
    key = list(key)
    if existing is not None:
        there = existing.select(*key).distinct().alias("e")
        stream = stream.alias("n").join(there, null_safe("n", "e", key), "left_anti")
    shared = stream.withColumn("_share", F.pmod(F.xxhash64(*spread_by), F.lit(shares)))
    return shared.dropDuplicates([*key, "_share"]).dropDuplicates(key).drop("_share")


def _last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def stream_insert_within_delay(
    stream: DataFrame,
    key: Sequence[str],
    ts: str,
    delay: int,
    root: str,
    checkpoint: str,
    spread_by: Sequence[str],
    shares: int = 16,
) -> StreamingQuery:
    """Let a row of each key through with a state that forgets, and put rows that come too late aside, for all data
    available now.

    A key is kept in the state until the watermark, ``delay`` seconds behind the greatest event time ``ts`` of the batches
    before, has passed ``delay`` seconds after its row; so the state holds the keys of about two delays. A row behind the
    watermark never reaches it: each batch writes such rows, and those without a time, below ``root`` beside the rows that
    passed, in one commit by the batch's number. ``taken_up`` makes both into a table with each key once.

    As for ``stream_insert_if_absent`` copies are dropped within shares of a key's rows first, so that a frequent key does
    not end in one task.
    """
    key = list(key)
    timed = stream.where(F.col(ts).isNotNull()).withWatermark(ts, f"{int(delay)} seconds")
    shared = timed.withColumn("_share", F.pmod(F.xxhash64(*spread_by), F.lit(shares)))
    passed = shared.dropDuplicatesWithinWatermark([*key, "_share"]).dropDuplicatesWithinWatermark(key).drop("_share")
    # both branches read the same batch; the second has no state and no watermark
    both = passed.withColumn("_passed", F.lit(True)).unionByName(stream.withColumn("_passed", F.lit(False)))
    micros = F.unix_micros(F.col(ts))

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is replayed is worked through too, as the state has to be written again
        spark = batch.sparkSession
        earlier = [n for n in commits.numbers(spark, root) if n < batch_id]
        seen = commits.read(spark, root, earlier[-1])["seen"] if earlier else None
        # at or above the watermark that the state was given, which starts at 1970, so that no row which it did not see
        # is missed
        late = F.col(ts).isNull() | (micros <= max(0, (seen or 0) - int(delay) * 1_000_000))
        folder, times = commits.new_folder(), Observation()
        watched = batch.observe(times, F.max(F.when(~F.col("_passed"), micros)).alias("greatest"))
        watched.where(F.col("_passed") | late).write.parquet(f"{root}/{folder}")
        greatest = max((t for t in (seen, times.get["greatest"]) if t is not None), default=None)
        _commit_batch(spark, root, batch_id, {"folders": [folder], "seen": greatest, "schema": batch.schema.jsonValue()})

    return (
        both.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _commit_batch(spark: SparkSession, root: str, batch: int, entry: dict) -> None:
    """A batch has the number of its commit: one that is replayed finds it taken, and what it wrote does not count."""
    try:
        commits.commit(spark, root, batch, entry)
    except commits.Conflict:
        pass


def arrivals(spark: SparkSession, root: str, which: str) -> DataFrame | None:
    """Rows of all batches below ``root`` that were ``inserted`` or came ``late``; None before the first batch."""
    entries = [commits.read(spark, root, n) for n in commits.numbers(spark, root)]
    if not entries:
        return None
    rows = spark.read.schema(T.StructType.fromJson(entries[-1]["schema"])).parquet(*[f"{root}/{e['folders'][0]}" for e in entries])
    return rows.where("_passed" if which == "inserted" else "not _passed").drop("_passed")


def taken_up(
    spark: SparkSession, root: str, existing: DataFrame, key: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """``existing`` with what ``stream_insert_within_delay`` let through and put aside: ``insert_if_absent`` of both."""
    inserted, late = (arrivals(spark, root, which) for which in ("inserted", "late"))
    if inserted is None:
        return existing
    return insert_if_absent(existing, inserted.unionByName(late), key, order)


def _last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def stream_sync_apply(
    stream: DataFrame, deltas: str, checkpoint: str, key: Sequence[str], order: Sequence[str]
) -> StreamingQuery:
    """Write the last row per key of each batch below ``deltas``, for all data available now.

    A batch costs no more than its own rows: the target is not read or rewritten. Each batch gets a folder
    of its own and counts from its commit on; a batch that is replayed after that is left out, so that readers
    never see a part of one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id not in commits.numbers(spark, deltas):
            folder = commits.new_folder()
            _last_per_key(batch, key, order).write.parquet(f"{deltas}/{folder}")
            _commit_batch(spark, deltas, batch_id, {"folders": [folder], "schema": batch.schema.jsonValue()})

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _changes(spark: SparkSession, deltas: str, after: int) -> tuple[DataFrame | None, int]:
    """Rows of the batches after a number, not folded yet, and the number of the last one."""
    open_batches = [n for n in commits.numbers(spark, deltas) if n > after]
    if not open_batches:
        return None, after
    entries = [commits.read(spark, deltas, n) for n in open_batches]
    schema = T.StructType.fromJson(entries[-1]["schema"])
    return spark.read.schema(schema).parquet(*[f"{deltas}/{e['folders'][0]}" for e in entries]), open_batches[-1]


def stream_synced(
    spark: SparkSession, target: DataFrame, deltas: str, key: Sequence[str], order: Sequence[str], after: int = -1
) -> DataFrame:
    """The target with all published batches after number ``after``, last row per key by ``order``: additive
    ``sync_apply``. Before the first batch it is the target itself."""
    changes, _ = _changes(spark, deltas, after)
    if changes is None:
        return target
    return sync_apply(_last_per_key(changes, key, order), target, key, "additive")


def folded_target(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The target last published by ``fold_batches`` and the number of the last batch in it."""
    target, _, entry = buckets.bucketed(spark, root)
    return target, entry["upto"]


def start_target(target: DataFrame, root: str, key: Sequence[str], count: int = buckets.BUCKETS) -> None:
    """Publish a first target, unique by ``key``, in ``count`` hash buckets and with no batch in it."""
    buckets.start_buckets(target, root, key, count, upto=-1)


def fold_batches(spark: SparkSession, root: str, deltas: str, order: Sequence[str]) -> DataFrame:
    """Publish the target below ``root`` with all batches since; they are left out from then on.

    Only buckets with a key of these batches are rewritten. The buckets' folders and the number of the last batch are
    one commit, so a run that is cut off changes nothing, and of two at once one gets ``commits.Conflict``. Returns the
    target. ``commits.forget(spark, deltas, upto, retention)`` and ``commits.clean(spark, root, retention)`` remove
    batches that were folded and buckets that were replaced.
    """
    _, _, entry = buckets.bucketed(spark, root, only=[])
    changes, last = _changes(spark, deltas, entry["upto"])
    if changes is not None:
        buckets.upsert(_last_per_key(changes, entry["key"], order), root, upto=last)
    return folded_target(spark, root)[0]
