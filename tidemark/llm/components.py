"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.operators import spread


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _with_least(pairs: DataFrame, least, most: int) -> DataFrame:
    """Add ``_m``, the least node around ``u``; there are no more than ``most`` pairs."""
    around = pairs.groupBy("u").agg(least.alias("_m"), F.count(F.lit(1)).alias("_rows"))
    if most <= spread.HEAVY * spread.SLICE_ROWS:  # no node can have enough for a join to be spread
        return pairs.join(around.drop("_rows"), "u")
    return spread.spread_join(pairs, around.drop("_rows"), ["u"], "inner", ["v"], around.select("u", "_rows"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); component is its least node.

    Each round every node points its neighbours to the least node it sees, until nothing changes; rounds
    grow with the logarithm of a component's size. A round is two joins over the links, spread where a
    node has many. Links with a null end or from a node to itself are ignored; direction and repeats do
    not matter.
    """
    ends = [F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")]
    links = written(links.where("u <> v").select(*ends).distinct().select("u", "v"), "links")
    before = None
    while (now := _fingerprint(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.first("u")), 2 * now[0]).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        small = _with_least(large, F.min("v"), 2 * now[0])
        small = small.select("u", F.col("_m").alias("v")).unionByName(
            small.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        )
        links = written(small.distinct(), "links")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(centres)
