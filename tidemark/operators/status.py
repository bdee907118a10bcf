"""Classify entities by ordered gates and sum up a fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate_classify(
    df: DataFrame, entity: Sequence[str], gates: Sequence[tuple[str, str, Column]], otherwise: str
) -> DataFrame:
    """One ``outcome`` per entity: that of the first gate, in order, where it stops.

    A gate is (outcome, kind, condition). ``need``: the entity stops when none of its rows meets the
    condition. ``stop``: it stops when one does. One aggregation, summed map-side.
    """
    met = [
        F.coalesce(F.bool_or(condition), F.lit(False)).alias(f"_gate{i}")
        for i, (_, _, condition) in enumerate(gates)
    ]
    result = F.lit(otherwise)
    for i, (outcome, kind, _) in reversed(list(enumerate(gates))):
        if kind not in ("need", "stop"):
            raise ValueError(f"unknown kind of gate: {kind}")
        stops = F.col(f"_gate{i}") if kind == "stop" else ~F.col(f"_gate{i}")
        result = F.when(stops, outcome).otherwise(result)
    return df.groupBy(*entity).agg(*met).select(*entity, result.alias("outcome"))


def fleet_summary(classified: DataFrame, group: Sequence[str], ok: Sequence[str]) -> DataFrame:
    """Per group: total, ok, failed and a verdict ``all``, ``partial`` or ``failed``."""
    succeeded = F.coalesce(F.col("outcome").isin(list(ok)), F.lit(False))
    counts = classified.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(succeeded).alias("ok")
    )
    verdict = F.when(F.col("ok") == F.col("total"), "all").when(F.col("ok") > 0, "partial").otherwise("failed")
    return counts.select(
        *group, "total", "ok", (F.col("total") - F.col("ok")).alias("failed"), verdict.alias("verdict")
    )


def fleet_failures(
    classified: DataFrame, group: Sequence[str], entity: Sequence[str], ok: Sequence[str]
) -> DataFrame:
    """The list behind ``failed``: one row per failed entity with ``entry`` = name and reason.

    Rows, as a group may have any number of failures; ``fleet_failed_list`` gathers them in arrays.
    """
    failed = ~F.coalesce(F.col("outcome").isin(list(ok)), F.lit(False))
    reason = F.coalesce("outcome", F.lit("unknown"))
    entry = F.concat_ws(" - ", *[F.col(c).cast("string") for c in entity], reason)
    rest = [c for c in entity if c not in group]
    return classified.where(failed).select(*group, *rest, entry.alias("entry"))


def fleet_failed_list(
    classified: DataFrame, group: Sequence[str], entity: Sequence[str], ok: Sequence[str], pages: int
) -> DataFrame:
    """The failures of each group as sorted arrays: group, ``page``, ``failed_list``.

    An entry's page, from 0 to ``pages`` - 1, is a hash of its text, whatever the size of the table; pages
    without entries are left out. Take enough of them for a page of the largest group to fit one task.
    """
    failures = fleet_failures(classified, group, entity, ok)
    digest = F.conv(F.substring(F.md5("entry"), 1, 8), 16, 10).cast("long")
    page = F.pmod(digest, F.lit(pages)).alias("page")
    lists = failures.groupBy(*group, page).agg(F.array_sort(F.collect_list("entry")).alias("failed_list"))
    return lists.select(*group, "page", "failed_list")
