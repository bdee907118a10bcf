"""What the plans must not hold, for every query; and what some must."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import sync
from tidemark.plans.queries import QUERIES
from tidemark.sources import publish
from tidemark.sources.tables import load

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for unwanted in ("EvalPython", "CartesianProduct", "NestedLoopJoin", "MapInPandas", "FlatMapGroups"):
        assert unwanted not in text, unwanted
    assert not unpartitioned_windows(text)


def unpartitioned_windows(text):
    """Window nodes end in the lists of partition and order columns; an empty list is not shown."""
    windows = [line for line in text.splitlines() if re.match(r"[ :+|*()0-9-]*Window \[", line)]
    return [line for line in windows if not re.search(r"\], \[[^\]]+\], \[[^\]]+\]$", line.strip())]


def test_an_unpartitioned_window_is_seen(spark):
    number = lambda window: spark.range(9).select("id", F.row_number().over(window).alias("n"))
    assert unpartitioned_windows(plan(number(Window.orderBy("id"))))
    assert not unpartitioned_windows(plan(number(Window.partitionBy("id").orderBy("id"))))


def test_scans_read_only_what_is_needed(spark):
    text = plan(QUERIES["sync_plan"](spark, FOLDER))
    assert "o_orderpriority" in text  # the old snapshot filters on it
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert reads and not any("o_orderdate" in r and "o_orderpriority" in r for r in reads)
    pushed = plan(QUERIES["allow_list_filter"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^]]*In\(event_type", pushed)


def test_missing_items_shuffles_each_side_once(spark, settings):
    settings(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1")
    orders, lines = load(spark, FOLDER, "orders", "lineitem")
    out = sync.missing_items(
        orders.select(F.col("o_orderkey").alias("k")), lines.select(F.col("l_orderkey").alias("k")), ["k"]
    )
    assert plan(out).count("Exchange hashpartitioning") == 1  # of both sides together


def test_restoring_prunes_other_snapshots(spark, tmp_path):
    for ts in (1, 2, 3):
        history = publish.snapshot_history(spark.range(ts * 10), str(tmp_path / "h"), ts)
    latest = publish.snapshot_latest(history, 2)
    assert "PartitionFilters: [isnotnull(snapshot_ts" in plan(latest)
    assert "Subquery" in plan(latest).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert latest.count() == 20


@pytest.mark.parametrize("name", ["longest_ok_prefix", "priority_fallback"])
def test_rows_are_counted_in_the_one_pass_that_aggregates(spark, settings, name):
    settings(spark__sql__adaptive__enabled="false")
    text = plan(QUERIES[name](spark, FOLDER))
    # once for the aggregate that all uses share, once for the rows
    assert text.count("FileScan parquet") == 2
