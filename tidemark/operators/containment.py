"""Which network an address lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.addresses import address_number, is_address, is_network, network_base, network_parts
from tidemark.operators.spread import lookup_join, spread_join


def _known(networks: DataFrame, cidr: str) -> DataFrame:
    number, length = network_parts(F.col(cidr))
    return (
        networks.where(is_network(F.col(cidr)))
        .select(F.col(cidr).alias("cidr"), number.alias("_number"), length.alias("_length"))
        .distinct()
        .select("cidr", "_length", network_base(F.col("_number"), F.col("_length")).alias("_base"))
    )


def cidr_match(
    addresses: DataFrame, networks: DataFrame, id: str, ip: str, cidr: str, longest: bool = False
) -> DataFrame:
    """(id, ip, cidr) for each network that contains the address; with ``longest`` only the narrowest.

    Each input row counts by itself, also where ids or addresses repeat. Containment becomes an equi-join:
    each distinct address is masked once per prefix length in use (33 at most) and looked up by (length,
    masked address). Networks are given by any address in them; of two that are the same network but
    written differently, ``longest`` takes the greater text.
    """
    known = _known(networks, cidr)
    lengths = known.agg(F.collect_set("_length"))  # no more than 33 values
    asked = addresses.where(is_address(F.col(ip))).select(id, ip)
    counts = asked.groupBy(ip).agg(F.count(F.lit(1)).alias("_rows"))
    masked = (
        counts.select(ip, address_number(F.col(ip)).alias("_number"))
        .withColumn("_length", F.explode(lengths.scalar()))
        .select(ip, "_length", network_base(F.col("_number"), F.col("_length")).alias("_base"))
    )
    found = lookup_join(masked, known, ["_length", "_base"], "inner", [ip])
    if longest:
        found = found.groupBy(ip).agg(F.max_by("cidr", F.struct("_length", "cidr")).alias("cidr"))
    return spread_join(asked, found.select(ip, "cidr"), [ip], "inner", [id], counts).select(id, ip, "cidr")
