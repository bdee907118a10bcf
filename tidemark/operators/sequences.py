"""Order-dependent logic without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.spread import null_safe_spread_join, shared

# Lines handled by one window; a long document is cut into chunks of this many.
CHUNK_LINES = 65_536


def last_wins_kv(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The value of the last entry per key. ``order`` must be unique within a key."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def current_pointer(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Where each key points now, from a log of re-pointings: key, ``current`` and ``moves``."""
    return df.groupBy(*key).agg(
        F.max_by(value, F.struct(*order)).alias("current"), F.count(F.lit(1)).alias("moves")
    )


def first_match(
    df: DataFrame, predicate: Column, order: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """The first row, by a unique ``order``, that passes; one per group when there are groups."""
    passing = df.where(predicate)
    if not group:
        return passing.orderBy(*order).limit(1)
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    out = passing.groupBy(*group).agg(first)
    return out.select(*[F.col(c) if c in group else F.col(f"_row.{c}").alias(c) for c in df.columns])


def longest_ok_prefix(df: DataFrame, group: Sequence[str], seq: str, ok: Column) -> DataFrame:
    """Per group the largest ``seq`` reached before the first failure; null if the first one fails.

    The first failure of each group is found by aggregation and joined back on, heavy groups in slices.
    ``seq`` is unique within a group; a null ``ok`` counts as a failure, a null group is one like any other.
    """
    probes = df.select(*group, F.col(seq).alias("_seq"), F.coalesce(ok, F.lit(False)).alias("_ok"))
    stops = probes.groupBy(*group).agg(
        F.min(F.when(~F.col("_ok"), F.col("_seq"))).alias("_stop"), F.count(F.lit(1)).alias("_rows")
    )
    stops = shared(stops, "_stop")
    before = F.col("_stop").isNull() | (F.col("_seq") < F.col("_stop"))
    counts = stops.select(*group, "_rows")
    joined = null_safe_spread_join(probes.drop("_ok"), stops, group, "inner", ["_seq"], counts)
    return joined.groupBy(*group).agg(F.max(F.when(before, F.col("_seq"))).alias("last_ok"))


def priority_fallback(
    df: DataFrame, group: Sequence[str], priority: str, eligible: Column, spread_by: Sequence[str]
) -> DataFrame:
    """Eligible rows of the first source, by ``priority``, that has any; per group, null being one too."""
    candidates = df.where(eligible)
    best = candidates.groupBy(*group).agg(
        F.min(priority).alias("_best"), F.count(F.lit(1)).alias("_rows")
    )
    best = shared(best).where(F.col("_best").isNotNull())
    counts = best.select(*group, "_rows")
    joined = null_safe_spread_join(candidates, best, group, "inner", spread_by, counts)
    return joined.where(F.col(priority) == F.col("_best")).select(*df.columns)


def block_spans(
    lines: DataFrame, doc: str, pos: str, line: str, begin: str, end: str, chunk: int = CHUNK_LINES
) -> DataFrame:
    """Add ``in_block`` and ``block_no`` to each line of documents with marked blocks.

    A begin line opens a block (also within one), an end line closes it; markers are whole lines. The
    state at the start of each chunk comes from a summary with one row per chunk, so that the lines of
    one long document are handled by many tasks.
    """
    mark = F.when(F.col(line) == begin, 1).when(F.col(line) == end, 0)
    marked = lines.withColumn("_mark", mark).withColumn("_chunk", F.floor(F.col(pos) / chunk))
    per_chunk = marked.groupBy(doc, "_chunk").agg(
        # last mark of the chunk, packed with its position to keep the buffer a plain number
        F.max(F.when(F.col("_mark").isNotNull(), F.col(pos).cast("long") * 2 + F.col("_mark"))).alias("_last"),
        F.count_if(F.col("_mark") == 1).alias("_opened"),
    )
    earlier = Window.partitionBy(doc).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        doc,
        "_chunk",
        (F.max("_last").over(earlier) % 2).alias("_open_before"),
        F.sum("_opened").over(earlier).alias("_count_before"),
    ).where(F.col("_chunk") > 0)
    so_far = Window.partitionBy(doc, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns(
        {
            "_open": F.last("_mark", ignorenulls=True).over(so_far),
            "_count": F.sum(F.when(F.col("_mark") == 1, 1).otherwise(0)).over(so_far),
        }
    )
    return local.join(carry, [doc, "_chunk"], "left").select(
        *lines.columns,
        (F.coalesce("_open", "_open_before", F.lit(0)) == 1).alias("in_block"),
        (F.col("_count") + F.coalesce("_count_before", F.lit(0))).alias("block_no"),
    )
