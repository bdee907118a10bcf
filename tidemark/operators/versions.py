"""Choosing and ranking versions in natural order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.versions import is_preview, is_stable, is_version, version_key
from tidemark.operators.ranges import cut_in_ranges
from tidemark.operators.spread import shared, spread_join


def _versions(df: DataFrame, group: Sequence[str], version: str) -> DataFrame:
    """Distinct versions per group with the sort key and the number of rows of each.

    The key is worked out after copies are gone, and a group's copies are gone before its rows meet.
    The filter is on the version: one on the key would be pushed down and work it out for every row.
    """
    copies = df.where(is_version(F.col(version))).groupBy(*group, version)
    counts = shared(copies.agg(F.count(F.lit(1)).alias("_rows")))
    return counts.withColumn("_key", version_key(F.col(version)))


def _policy_rank(version: Column, policy: str) -> Column:
    if policy == "preview_first":
        return F.when(is_preview(version), 2).otherwise(1)
    if policy == "stable_first":
        return F.when(is_stable(version), 2).otherwise(1)
    raise ValueError(f"unknown policy: {policy}")


def latest_version(df: DataFrame, group: Sequence[str], version: str, policy: str) -> DataFrame:
    """Greatest version per group.

    ``preview_first``: the greatest preview, else the greatest stable one, nothing else.
    ``stable_first``: the greatest stable one, else the greatest of any kind.
    Text that does not start with a digit is no version.
    """
    ranked = _versions(df, group, version).withColumn("_rank", _policy_rank(F.col(version), policy))
    if policy == "preview_first":
        ranked = ranked.where(is_preview(F.col(version)) | is_stable(F.col(version)))
    return ranked.groupBy(*group).agg(F.max_by(version, F.struct("_rank", "_key")).alias(version))


def distinct_versions(df: DataFrame, group: Sequence[str], version: str) -> DataFrame:
    """Each version once, groups and versions in order (a range-partitioned sort)."""
    return _versions(df, group, version).orderBy(*group, "_key").select(*group, version)


def version_sort(df: DataFrame, group: Sequence[str], version: str, spread_by: Sequence[str]) -> DataFrame:
    """Add ``rank``, the place of a row's version among its group's versions in natural order.

    Equal versions share a place; it is null for rows without a group or with text that is no version
    (versions start with a digit). Distinct versions are cut into ranges by their number, ranked within a
    range, and shifted by what the group has in lower ranges, so that no window covers a whole group.
    """
    group = list(group)
    distinct = _versions(df, group, version).select(*group, version, "_rows", "_key")
    versions = cut_in_ranges(distinct, *map(F.col, group), F.col("_key"))
    within = Window.partitionBy(*group, "_range").orderBy("_key")
    lower = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        versions.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*group, "_range", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_shift"))
    )
    ranks = (
        versions.withColumn("_place", F.row_number().over(within))
        .join(shift, [*group, "_range"])
        .select(*group, version, (F.col("_place") + F.col("_shift")).alias("rank"))
    )
    counts = versions.select(*group, version, "_rows")
    placed = spread_join(df, ranks, [*group, version], "left", spread_by, counts)
    return placed.select(*df.columns, "rank")
