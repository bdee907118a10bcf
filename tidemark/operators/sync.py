"""Keeping one keyed table in step with another: what is missing, what differs, what to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import path_parts
from tidemark.operators.sequences import last_wins_kv
from tidemark.operators.spread import lookup_join, null_safe, spread_join


def missing_items(required: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys required but not present, each once. A null is a key like any other.

    Both sides meet in one aggregation, summed map-side, so copies of a key cost nothing.
    """
    key = list(key)
    asked = required.select(*key, F.lit(False).alias("_there"))
    both = asked.unionByName(present.select(*key, F.lit(True).alias("_there")))
    return both.groupBy(*key).agg(F.bool_or("_there").alias("_there")).where(~F.col("_there")).drop("_there")


def fanout_plan(targets: DataFrame, items: DataFrame, every: str = "all") -> DataFrame:
    """Each target with each item of the type it wants, and what to do about it.

    ``targets``: target (unique), available, wanted (a type, or ``every`` for items of any type or none).
    ``items``: item, type, present. Action: ``sync``, ``skip_unreachable`` or ``skip_missing_source``. What
    is not known to be available or present is not.
    """
    offered = F.explode(F.array_distinct(F.array(F.col("type"), F.lit(every)))).alias("wanted")
    pairs = lookup_join(targets, items.select("item", "present", offered), ["wanted"], "inner", ["target"])
    action = (
        F.when(~F.coalesce("available", F.lit(False)), "skip_unreachable")
        .when(~F.coalesce("present", F.lit(False)), "skip_missing_source")
        .otherwise("sync")
    )
    return pairs.select("target", "item", action.alias("action"))


def sync_plan(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    mode: str = "mirror",
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """Difference of two snapshots, each unique by ``key``: key and ``action``.

    ``create``, ``update``, ``skip``, and for keys only in the target ``delete`` (mirror) or ``keep``
    (additive). ``compare`` defaults to all other columns that both sides have. A null is a key like any other.
    """
    if mode not in ("mirror", "additive"):
        raise ValueError(f"unknown mode: {mode}")
    key = list(key)
    if compare is None:
        compare = [c for c in source.columns if c in target.columns and c not in key]
    s = source.select(*key, *compare, F.lit(True).alias("_in")).alias("s")
    t = target.select(*key, *compare, F.lit(True).alias("_in")).alias("t")
    action = (
        F.when(F.col("t._in").isNull(), "create")
        .when(F.col("s._in").isNull(), "delete" if mode == "mirror" else "keep")
        .when(null_safe("s", "t", compare), "skip")
        .otherwise("update")
    )
    keys = [F.when(F.col("s._in"), F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name) for name in key]
    return s.join(t, null_safe("s", "t", key), "full_outer").select(*keys, action.alias("action"))


def sync_apply(source: DataFrame, target: DataFrame, key: Sequence[str], mode: str = "mirror") -> DataFrame:
    """The target as it is after the plan. A null is a key like any other."""
    if mode == "mirror":
        return source.select(*target.columns)
    if mode != "additive":
        raise ValueError(f"unknown mode: {mode}")
    kept = target.alias("t").join(source.select(*key).alias("s"), null_safe("t", "s", key), "left_anti")
    return source.select(*target.columns).unionByName(kept)


def _cache_key(df: DataFrame, url: str, by: str) -> DataFrame:
    if by == "url":
        return df.withColumn("_key", F.col(url))
    if by == "basename":
        return path_parts(df, url, "_").drop("_dirname").withColumnRenamed("_basename", "_key")
    raise ValueError(f"unknown key: {by}")


def cache_resolve(
    requests: DataFrame,
    cache: DataFrame,
    url: str,
    row_id: Sequence[str],
    offline: bool = False,
    by: str = "url",
) -> DataFrame:
    """Add ``status`` to each request: ``hit`` whenever cached, else ``fetch``, or ``miss_offline``.

    ``by='basename'`` keys the cache by the last part of the URL only. ``row_id`` tells requests apart:
    one URL may be asked for very often.
    """
    asked = _cache_key(requests, url, by)
    held = _cache_key(cache, url, by).select("_key").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit"), "hit").otherwise("miss_offline" if offline else "fetch")
    joined = spread_join(asked, held, ["_key"], "left", row_id, sketch=True)
    return joined.select(*requests.columns, status.alias("status"))


def cache_after(requests: DataFrame, cache: DataFrame, url: str, by: str = "url") -> DataFrame:
    """Cache keys after all misses were fetched and written through."""
    asked = _cache_key(requests, url, by).select("_key")
    held = _cache_key(cache, url, by).select("_key")
    return asked.unionByName(held).distinct().withColumnRenamed("_key", "key")


def config_drift(
    desired: DataFrame,
    observed: DataFrame,
    key: Sequence[str],
    value: str,
    order: Sequence[str],
    commented: str | None = None,
    commented_counts: bool = False,
) -> DataFrame:
    """Add ``action`` to each desired setting (unique by ``key``): ``skip``, ``replace`` or ``append``.

    The last observed entry by ``order`` decides. A null is a key like any other. Entries whose ``commented`` column is true are left
    out unless ``commented_counts``.
    """
    entries = observed
    if commented and not commented_counts:
        entries = entries.where(~F.coalesce(F.col(commented), F.lit(False)))
    latest = last_wins_kv(entries, key, value, order).select(
        *key, F.col(value).alias("_now"), F.lit(True).alias("_found")
    )
    action = (
        F.when(F.col("_found").isNull(), "append")
        .when(F.col(f"d.{value}").eqNullSafe(F.col("_now")), "skip")
        .otherwise("replace")
    )
    joined = desired.alias("d").join(latest.alias("l"), null_safe("d", "l", key), "left")
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in desired.columns], action.alias("action"))


def drift_verdict(drift: DataFrame, group: Sequence[str]) -> DataFrame:
    """Whether a group has to be touched at all: ``skip`` when all its settings are as desired."""
    settled = F.bool_and(F.col("action") == "skip")
    verdict = F.when(settled, "skip").otherwise("apply")
    return drift.groupBy(*group).agg(verdict.alias("verdict"))


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """``existing`` and those incoming rows whose key it lacks, one per key. Running it again adds nothing.

    A null is a key like any other.

    Where rows hold more than the key, ``order`` (unique) says which incoming row of a key is taken.
    """
    key = list(key)
    rest = [c for c in existing.columns if c not in key]
    if rest and not order:
        raise ValueError("rows with more than the key need an order")
    if rest:
        first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
        new = incoming.groupBy(*key).agg(first).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    else:
        new = incoming.select(*key).distinct()
    new = new.alias("n").join(existing.select(*key).distinct().alias("e"), null_safe("n", "e", key), "left_anti")
    return existing.unionByName(new.select(*existing.columns))
