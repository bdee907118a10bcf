"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, whole, written
from tidemark.operators.spread import fits_broadcast, lookup_join, spread_join

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, key: str, text: str, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z; of a group the largest ``key`` stays.

    Returns one row per input row: ``key``, keep_id, group_size, kept, and the columns of ``carry``
    (name to an expression over ``docs``). Only texts that share their length and the hash of their
    first PREFIX_CHARS characters with another row are hashed in full.

    A null text is empty, and empty texts are equal. A null key counts as the smallest; a group of null
    keys only has a null keep_id. One row of each group is kept, also if its key is repeated or null.
    Other columns of ``docs``, whatever their names, are ignored. An empty table gives no rows.
    """
    carry = dict(carry or {})
    body = ascii_lower(whole(F.col(text)))
    rows = docs.select(
        F.col(key).alias("_key"),
        F.octet_length(body).alias("_length"),
        F.xxhash64(F.substring(body, 1, PREFIX_CHARS)).alias("_prefix"),
        body.alias("_body"),
        *[expression.alias(f"_c_{name}") for name, expression in carry.items()],
    )
    carried = [f"_c_{name}" for name in carry]

    keys = written(rows.select("_length", "_prefix"), "dedup-keys")
    lengths = keys.groupBy("_length").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    same_length = lookup_join(keys, lengths.select("_length"), ["_length"], "left_semi", ["_prefix"])
    prefixes = same_length.groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    prefixes = written(prefixes.select("_length", "_prefix", F.lit(True).alias("_alike")), "dedup-prefixes")

    on = ["_length", "_prefix"]
    full = F.sha2(F.col("_body"), 256)
    if fits_broadcast(prefixes):
        alike = rows.join(F.broadcast(prefixes), on, "left").withColumn("_full", F.when(F.col("_alike"), full))
    else:
        # hashing a text costs less than sending it through the shuffle of this join
        hashed = rows.withColumn("_full", full).drop("_body")
        alike = spread_join(hashed, prefixes, on, "left", ["_key", "_full"])
        alike = alike.withColumn("_full", F.when(F.col("_alike"), F.col("_full")))
    # the number, written with the rows, tells apart those that repeat a key
    numbered = alike.select("_key", "_length", "_full", *carried, F.monotonically_increasing_id().alias("_row"))
    alike = written(numbered, "dedup-rows")

    twins = alike.where(F.col("_full").isNotNull())
    groups = twins.groupBy("_length", "_full").agg(F.max(F.struct("_key", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_rows"))
    counts = groups.select("_length", "_full", "_rows")
    in_groups = spread_join(twins, groups, ["_length", "_full"], "inner", ["_key"], counts)
    alone = alike.where(F.col("_full").isNull())
    columns = ["_key", "_row", "_keep", "_rows", *carried]
    itself = F.struct("_key", "_row").alias("_keep")
    found = in_groups.select(*columns).unionByName(
        alone.select("_key", "_row", itself, F.lit(1).cast("long").alias("_rows"), *carried)
    )
    return found.select(
        F.col("_key").alias(key),
        F.col("_keep._key").alias("keep_id"),
        F.col("_rows").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        *[F.col(f"_c_{name}").alias(name) for name in carry],
    )
