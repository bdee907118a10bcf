"""Comparing two snapshots by digests of key ranges, so that only ranges that differ are joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spread import null_safe
from tidemark.operators.sync import sync_plan

COARSE, FINE = 64, 256  # coarse ranges, and fine ones in each


def ranges_of(key: Sequence[str], coarse: int = COARSE, fine: int = FINE) -> Column:
    """Number of a key's fine range, by a hash; divided by ``fine`` it is that of its coarse range."""
    return F.pmod(F.xxhash64(*key), F.lit(coarse * fine)).cast("int")


def _row_hashes(columns: Sequence[str]) -> list[Column]:
    """Two hashes of a row. Hash functions pass over nulls, so which values are null is hashed too."""
    marks = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return [F.xxhash64(F.lit(seed), marks, *columns) for seed in (1, 2)]


def key_digests(
    df: DataFrame, key: Sequence[str], compare: Sequence[str], coarse: int = COARSE, fine: int = FINE
) -> DataFrame:
    """(coarse, fine, rows, one, two): a digest of each key range, whatever the order of its rows.

    The digests of a range's rows are joined by xor, in the tasks first, so no more than coarse x fine rows a task are
    shuffled. They can be kept with a snapshot; those of a coarse range are the xor of its fine ones.
    """
    one, two = _row_hashes([*key, *compare])
    numbered = df.select(ranges_of(key, coarse, fine).alias("_range"), one.alias("_one"), two.alias("_two"))
    summed = numbered.groupBy("_range").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_one").alias("one"), F.bit_xor("_two").alias("two")
    )
    return summed.select(
        F.floor(F.col("_range") / fine).cast("int").alias("coarse"), F.col("_range").alias("fine"), "rows", "one", "two"
    )


def coarse_digests(digests: DataFrame) -> DataFrame:
    return digests.groupBy("coarse").agg(F.sum("rows").alias("rows"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))


def _differing(source: DataFrame, target: DataFrame, by: str) -> DataFrame:
    """Numbers ``by`` of ranges that only one side has or whose digests differ."""
    s, t = source.alias("s"), target.alias("t")
    both = s.join(t, F.col(f"s.{by}") == F.col(f"t.{by}"), "full_outer")
    return both.where(~null_safe("s", "t", ["rows", "one", "two"])).select(F.coalesce(f"s.{by}", f"t.{by}").alias(by))


def changed_ranges(source: DataFrame, target: DataFrame) -> DataFrame:
    """Fine ranges whose digests differ: coarse ranges first, then the fine ones in those that do."""
    coarse = _differing(coarse_digests(source), coarse_digests(target), "coarse")
    parts = [side.join(F.broadcast(coarse), "coarse", "left_semi") for side in (source, target)]
    return _differing(*parts, "fine")


def sync_plan_by_digest(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    mode: str = "mirror",
    compare: Sequence[str] | None = None,
    source_digests: DataFrame | None = None,
    target_digests: DataFrame | None = None,
    coarse: int = COARSE,
    fine: int = FINE,
) -> DataFrame:
    """``sync_plan``, same rows, but only key ranges whose digests differ are joined; in all others every row is ``skip``,
    and the target's rows there are not looked at.

    Digests kept with a snapshot (``key_digests`` by the same key, columns and numbers of ranges) spare the pass over
    it. Two rows have equal digests by chance once in 2^128. Both sides need the same types in the columns compared; other
    types only cost a join of all ranges. The list of ranges that differ, at most coarse x fine numbers, is read by the
    driver when this is called: without any there is no join at all.
    """
    key = list(key)
    if compare is None:
        compare = [c for c in source.columns if c in target.columns and c not in key]
    if source_digests is None:
        source_digests = key_digests(source, key, compare, coarse, fine)
    if target_digests is None:
        target_digests = key_digests(target, key, compare, coarse, fine)
    changed = sorted(row.fine for row in changed_ranges(source_digests, target_digests).collect())
    number = ranges_of(key, coarse, fine)
    skip = F.lit("skip").alias("action")
    if not changed:
        return source.select(*key, skip)
    listed = F.broadcast(source.sparkSession.createDataFrame([(n,) for n in changed], "_range int"))
    inside = lambda df, how: df.withColumn("_range", number).join(listed, "_range", how).drop("_range")
    differing = sync_plan(inside(source, "left_semi"), inside(target, "left_semi"), key, mode, compare)
    return inside(source, "left_anti").select(*key, skip).unionByName(differing)
