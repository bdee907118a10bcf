"""Mixing sources to target weights: weighted targets with a cap, epochs, Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ordered, written
from tidemark.operators.spread import spread_join

WEIGHTS = (1, 2, 3)
CAP = 3


def _numbered(names: DataFrame, column: str) -> DataFrame:
    """Number distinct names from 0 by code point, null last, without putting all rows in one task."""
    cut = ordered(names, F.col(column).asc_nulls_last())
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(F.col(column).asc_nulls_last())
    numbered = cut.join(F.broadcast(starts), "_range").withColumn("_i", F.row_number().over(within) - 1 + F.col("_start"))
    return numbered.drop("_range", "_start")


def targets(sources: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight): ``share`` of all sizes dealt out by weight.

    No target exceeds ``cap`` times its source's size; what is over is dealt out again by weight among the
    sources that are below, until none is above. Each round is one sum over the sources.
    """
    size, weight = F.col("source_size"), F.col("weight")
    limit = size * cap
    total = sources.agg(F.sum(size)).first()[0] or 0
    pool = total if share == 1 else total * share
    rate, full = 0.0, -1
    while True:
        over = (limit < F.lit(rate) * weight) if full >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(over, limit)).alias("fixed"),
            F.sum(F.when(~over, weight)).alias("open"),
            F.count_if(over).alias("full"),
        ).first()
        if row.full == full or not row.open:
            break
        full, rate = row.full, (pool - (row.fixed or 0)) / row.open
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(rate) * weight) if total else F.lit(0.0))


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1] that depends on the seed and the key only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame,
    key: str,
    source: str,
    size: Column,
    quality: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1,
    cap: int = CAP,
    seed: int = 42,
) -> DataFrame:
    """How often each document is taken so that each source comes near its share of the words.

    Sources in order of code point, null last, have the ``weights``, repeated as needed. A source whose
    target is some times its size is taken whole that often (epochs); for the rest its documents are
    drawn without replacement: each has the key ``-ln(u) / quality``, and documents are taken in the order
    of their keys while their sizes add up to the rest; the one that crosses it is taken if that comes
    nearer. Reruns agree, as ``u`` is a hash of the document's key.

    Returns one row per input row: key, size, source, source_size, target, copies, taken (copies x size).
    The order within a source is cut into ranges over all sources, so no source is too large for a task.

    A null source is a source of its own; a null size counts as 0, a null quality as 1; quality has to be
    positive. Rows that repeat a key have the same place in the order and are counted one by one. A table
    without words has targets of 0. Other columns, whatever their names, are ignored.
    """
    weight = F.coalesce(quality, F.lit(1.0)) if quality is not None else F.lit(1.0)
    base = docs.select(
        F.col(key).alias("_key"),
        F.col(source).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform(seed, F.col(key))) / weight).alias("_draw"),
    )
    base = ordered(base, F.col("source").asc_nulls_last(), F.col("_draw"), F.col("_key"))

    sizes = base.groupBy("source", "_range").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    sizes = written(sizes, "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_rows").alias("_rows"))
    numbered = _numbered(totals, "source")
    nth = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    sources = targets(written(numbered.withColumn("weight", nth.cast("long")), "mix-sources"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("_epochs", epochs.cast("long"))
    sources = sources.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))

    # a row per source and range: what lies before the range, and what the source is to give
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    place = [F.coalesce(F.col("source"), F.lit("")).alias("_name"), F.col("source").isNull().alias("_none")]
    starts = starts.select(*place, "_range", "_start", F.col("_rows").alias("_n"))
    plan = starts.join(sources.select(*place, "source_size", "target", "_epochs", "_rest"), ["_name", "_none"])

    within = Window.partitionBy("source", "_range").orderBy("_draw", "_key")
    running = base.withColumn("_upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    on = ["_name", "_none", "_range"]
    counts = starts.select(*on, F.col("_n").alias("_rows"))
    rows = spread_join(running.select("*", *place), plan.drop("_n"), on, "inner", ["_key"], counts)
    ahead = F.col("_start") + F.col("_upto") - F.col("size")
    drawn = (F.col("_rest") > 0) & (F.col("_rest") - ahead >= F.col("size") / 2)
    copies = F.col("_epochs") + drawn.cast("long")
    return rows.select(
        F.col("_key").alias(key),
        "size",
        "source",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
