"""Joins that stay even when one key holds a large part of all rows.

A shuffle join sends all rows of a key to one task. ``spread_join`` cuts each heavy key of the left side
into slices in proportion to its share and repeats the matching right rows once per slice. AQE's own skew
split covers only joins whose inputs are bare shuffles, and most right sides here are aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# All rows are thought of as SLICES equal slices, none below SLICE_ROWS rows; a key worth more than HEAVY
# of them is cut. Fewer than SLICES / HEAVY keys can be that large: this bounds the broadcast list of heavy
# keys, and SLICES + SLICES / HEAVY the right rows that are repeated.
SLICES = 131_072
SLICE_ROWS = 10_000
HEAVY = 4
CELLS = 65_536  # a cell has half of a heavy key's least share on average

# A lookup side is broadcast only when it is seen to be within both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame) -> bool:
    """Look at no more than BROADCAST_ROWS + 1 rows and say whether ``df`` may be broadcast."""
    seen = df.limit(BROADCAST_ROWS + 1).agg(
        F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")
    ).first()
    return seen[0] <= BROADCAST_ROWS and (seen[1] or 0) <= BROADCAST_BYTES


def shared(aggregate: DataFrame, *columns: str) -> DataFrame:
    """Add a filter that always holds, since ``_rows`` is a count, and that needs all ``columns``.

    It keeps them in every use of the aggregate, so that all uses are alike and share one shuffle.
    """
    holds = F.col("_rows") > 0
    for name in columns:
        holds = holds | F.col(name).isNotNull()
    return aggregate.where(holds)


def _slice_rows(counts: DataFrame) -> Column:
    """Rows of one slice, of all that ``counts`` has."""
    total = counts.agg(F.sum("_rows").alias("_total"))
    return F.greatest(total.scalar() / F.lit(float(SLICES)), F.lit(float(SLICE_ROWS)))


def cell_of(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(CELLS))


def sketched_counts(left: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Numbers of rows of all keys that may be heavy, and of all cells, without a shuffle of all keys.

    Rows are counted by cells, hashes of the key with CELLS values: a row per cell and task is shuffled. A heavy key makes
    its cell heavy, so that keys are counted in the few heavy cells only; the result is the same as of all counts.
    """
    keyed = left.select(*on)
    for name in on:
        keyed = keyed.where(F.col(name).isNotNull())
    cells = keyed.groupBy(cell_of(on).alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = cells.where(F.col("_rows") > HEAVY * _slice_rows(cells)).select("_cell")  # fewer than SLICES / HEAVY
    inside = keyed.withColumn("_cell", cell_of(on)).join(F.broadcast(heavy), "_cell", "left_semi")
    return inside.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), cells


def heavy_keys(counts: DataFrame, on: Sequence[str], of: DataFrame | None = None) -> DataFrame:
    """Of ``counts`` (keys and their number of rows), the hashes of keys to cut and their number of slices. ``of`` has
    all rows in its ``_rows``, if ``counts`` has not."""
    rows = _slice_rows(counts if of is None else of)
    return (
        counts.withColumn("_cut", F.ceil(F.col("_rows") / rows).cast("long"))
        .where(F.col("_cut") > HEAVY)
        # two numbers a key, however long it is; keys that share a hash are cut alike on both sides
        .groupBy(F.xxhash64(*on).alias("_heavy"))
        .agg(F.max("_cut").alias("_cut"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    counts: DataFrame | None = None,
    sketch: bool = False,
) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) of a left side that may be skewed.

    ``spread_by`` names columns that tell the left rows of one key apart; the slice is a hash of them,
    so a task run a second time puts each row where it was. ``counts`` is a table of the key columns and
    the number of left rows per key, ``_rows``, for callers that have one; otherwise rows are counted,
    with map-side partial sums, or with ``sketch`` by ``sketched_counts``, which reads the left side once more but does not
    shuffle its keys.
    """
    on = list(on)
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    cells = None
    if counts is None and sketch:
        counts, cells = sketched_counts(left, on)
    elif counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    # null keys are left out by joins anyway; saying so here too lets equal aggregates share a shuffle
    heavy = F.broadcast(heavy_keys(counts.where(~no_key), on, cells))

    row_hash = F.xxhash64(*spread_by)
    # a row without a key matches nothing, so it may go to any slice
    pieces: Column = F.when(no_key, SLICES).otherwise(F.coalesce("_cut", F.lit(1)))
    hashed = F.xxhash64(*on)
    cut_left = (
        left.withColumn("_heavy", hashed)
        .join(heavy, "_heavy", "left")
        .withColumn("_slice", F.coalesce(F.pmod(row_hash, pieces), F.lit(0)))
        .drop("_heavy", "_cut")
    )
    cut_right = (
        right.withColumn("_heavy", hashed)
        .join(heavy, "_heavy", "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_cut") - 1, F.lit(0)))))
        .drop("_heavy", "_cut")
    )
    return cut_left.join(cut_right, [*on, "_slice"], how).drop("_slice")


def null_safe_spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str], counts: DataFrame
) -> DataFrame:
    """``spread_join`` (inner, left) for which null is a key like any other."""
    keyed = lambda df: df.withColumn("_on", F.struct(*on))  # noqa: E731  a struct of nulls is not null
    counted = keyed(counts).select("_on", "_rows")
    return spread_join(keyed(left), keyed(right).drop(*on), ["_on"], how, spread_by, counted).drop("_on")


def null_safe(left: str, right: str, key: Sequence[str]) -> Column:
    """Condition of a join on ``key`` of two aliased sides for which null is a key like any other."""
    same = F.lit(True)
    for name in key:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str]
) -> DataFrame:
    """Join against a list-like table: broadcast when it is seen to fit, spread otherwise."""
    if fits_broadcast(right):
        return left.join(F.broadcast(right), list(on), how)
    return spread_join(left, right, on, how, spread_by)
