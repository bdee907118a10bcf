"""One key holds a third of all rows: results are whole and no task gets them all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.versions import version_key
from tidemark.operators import sequences, spread, status, versions
from tidemark.operators.ranges import cut_in_ranges
from tidemark.operators.spread import fits_broadcast, heavy_keys, lookup_join, sketched_counts, spread_join
from tidemark.operators.versions import version_sort

ROWS = 30_000


@pytest.fixture
def shuffled(settings):
    """Plain shuffle joins, nothing coalesced."""
    settings(
        spark__sql__adaptive__enabled="false",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="32",
    )


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(spread, "SLICE_ROWS", 10)


@pytest.fixture
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 1000)
    return spark.range(ROWS).select("id", key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, skewed, shuffled, how):
    right = spark.range(0, 1000, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    got = spread_join(skewed, right, ["key"], how, ["id"])
    want = skewed.join(right, ["key"], how)
    assert sorted(got.columns) == sorted(want.columns)
    got, want = got.select(want.columns), want
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_heavy_key_is_spread(spark, skewed, shuffled):
    right = spark.range(1000).select(F.col("id").alias("key"), F.lit(1).alias("v"))
    assert largest_share(skewed.join(right, ["key"], "left")) > 0.3
    assert largest_share(spread_join(skewed, right, ["key"], "left", ["id"])) < 0.1


def test_few_keys_are_heavy(spark, skewed, monkeypatch):
    monkeypatch.setattr(spread, "SLICE_ROWS", 1000)
    counts = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    heavy = heavy_keys(counts, ["key"])
    assert [r._heavy for r in heavy.collect()] == [spark.sql("select xxhash64(0L)").first()[0]]
    # however small a slice may be, the number of heavy keys is bounded
    monkeypatch.setattr(spread, "SLICE_ROWS", 1)
    monkeypatch.setattr(spread, "SLICES", 400)
    assert 1 <= heavy_keys(counts, ["key"]).count() < 100


def test_lookup_is_broadcast_only_within_bounds(spark, skewed, monkeypatch):
    right = spark.range(1000).select(F.col("id").alias("key"), F.lit("x" * 100).alias("v"))
    assert fits_broadcast(right)
    want = sorted(map(repr, lookup_join(skewed, right, ["key"], "left", ["id"]).collect()))
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 999)
    assert not fits_broadcast(right)
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 10_000)
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 50_000)
    assert not fits_broadcast(right)
    got = lookup_join(skewed, right, ["key"], "left", ["id"]).select("key", "id", "v")
    assert sorted(map(repr, got.collect())) == want


def test_prefix_of_a_heavy_group(spark, shuffled):
    pick = random.Random(5)
    rows, want = [], {}
    for group in range(40):
        length = 10_000 if group == 0 else 500
        stop = pick.choice([None, 0, length // 2, length - 1])
        rows += [(group, seq, stop is None or seq < stop or seq % 2 == 1 and seq != stop) for seq in range(length)]
        want[group] = length - 1 if stop is None else None if stop == 0 else stop - 1
    df = spark.createDataFrame(rows, "g int, seq long, ok boolean")
    got = sequences.longest_ok_prefix(df, ["g"], "seq", F.col("ok"))
    assert dict(map(tuple, got.collect())) == want


def test_ranks_of_a_heavy_group_and_many_copies(spark, shuffled):
    pick = random.Random(6)
    rows = [(i, 0 if i % 3 == 0 else i % 7, "1.2.3" if i % 4 == 0 else f"{pick.randint(0, 20)}.{pick.randint(0, 20)}.{pick.randint(0, 20)}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g int, v string")
    got = {r.id: r["rank"] for r in versions.version_sort(df, ["g"], "v", ["id"]).collect()}
    order = lambda v: [int(x) for x in v.split(".")]
    places = {}
    for group in {g for _, g, _ in rows}:
        distinct = sorted({v for _, g, v in rows if g == group}, key=order)
        places.update({(group, v): i + 1 for i, v in enumerate(distinct)})
    assert got == {i: places[g, v] for i, g, v in rows}


def test_lines_of_a_long_document_are_spread(spark, shuffled):
    lines = spark.range(ROWS).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc"),
        F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 3)).otherwise(0).cast("long").alias("pos"),
        F.when(F.col("id") % 900 == 0, "B").when(F.col("id") % 600 == 0, "E").otherwise("x").alias("line"),
    )
    spans = sequences.block_spans(lines, "doc", "pos", "line", "B", "E", chunk=100)
    assert largest_share(spans) < 0.15
    inside, count, want = False, 0, Counter()
    for id in range(0, ROWS, 3):
        if id % 900 == 0:
            inside, count = True, count + 1
        elif id % 600 == 0:
            inside = False
        want[inside, count] += 1
    got = spans.where("doc = 0").groupBy("in_block", "block_no").count().collect()
    assert {(r.in_block, r.block_no): r["count"] for r in got} == dict(want)


def test_failed_list_of_a_large_group_is_paged(spark, shuffled):
    outcome = F.when(F.col("id") % 5 == 0, "copied").otherwise("unreachable")
    group = F.when(F.col("id") < 8000, 0).otherwise(F.col("id")).alias("g")
    fleet = spark.range(8400).select(group, F.col("id").alias("node"), outcome.alias("outcome"))
    lists = status.fleet_failed_list(fleet, ["g"], ["node"], ["copied"], 64).collect()
    large = [r.failed_list for r in lists if r.g == 0]
    assert len(large) == 64 and max(map(len, large)) < 200
    assert all(page == sorted(page) for page in large)
    entries = sorted(entry for r in lists for entry in r.failed_list)
    assert entries == sorted(f"{i} - unreachable" for i in range(8400) if i % 5)


@pytest.mark.parametrize("shape", ["concat('0.0.0-', 20240000000000 + id, '-', hex(id * 7919))", "concat(id, '.0.0')"])
def test_versions_of_any_scheme_are_ranked_in_ranges(spark, settings, shape):
    """One group of 100,000 versions: no range, and so no window, holds much more than its share."""
    settings(spark__sql__shuffle__partitions="16")
    df = spark.range(100_000).select("id", F.lit("g").alias("g"), F.expr(shape).alias("v"))
    keyed = df.withColumn("_key", version_key(F.col("v")))
    sizes = [r["count"] for r in cut_in_ranges(keyed, F.col("g"), F.col("_key")).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 100_000 / 16
    ranked = version_sort(df, ["g"], "v", ["id"])
    wrong = ranked.where(F.col("rank") != F.col("id") + 1).count()
    assert wrong == 0 and ranked.count() == 100_000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sketched_like_counted(spark, skewed, shuffled, monkeypatch, how):
    """Same heavy keys, same rows, spread alike; with few cells, where light keys share the cells of heavy ones, too."""
    right = spark.range(0, 1000, 2).select(F.col("id").alias("key"), F.lit(1).alias("v"))
    exact = heavy_keys(skewed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("_rows")), ["key"])
    for cells in (65_536, 50):
        monkeypatch.setattr(spread, "CELLS", cells)
        counts, of = sketched_counts(skewed, ["key"])
        assert sorted(map(tuple, heavy_keys(counts, ["key"], of).collect())) == sorted(map(tuple, exact.collect()))
        got = spread_join(skewed, right, ["key"], how, ["id"], sketch=True)
        want = skewed.join(right, ["key"], how)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert largest_share(spread_join(skewed, right.union(right), ["key"], "left", ["id"], sketch=True)) < 0.1


def test_a_missed_key_costs_balance_only(spark, skewed, shuffled, monkeypatch):
    right = spark.range(0, 1000, 2).select(F.col("id").alias("key"), F.lit(1).alias("v"))
    monkeypatch.setattr(spread, "sketched_counts", lambda left, on: (left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).limit(0),) * 2)
    got = spread_join(skewed, right, ["key"], "left", ["id"], sketch=True)
    assert sorted(map(repr, got.select("key", "id", "v").collect())) == sorted(map(repr, skewed.join(right, "key", "left").collect()))


def test_the_large_side_is_shuffled_once(spark, shuffled):
    """Requests go through one exchange, that of the join; what counts them sends a row per cell and heavy key."""
    from tidemark.operators.sync import cache_resolve

    requests = spark.range(ROWS).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id") % 7000).alias("url"))
    cache = requests.where("page_id < 100").select("url")
    found = cache_resolve(requests, cache, "url", ["page_id"])
    assert found.count() == ROWS
    plan = found._jdf.queryExecution().executedPlan().toString()
    of_requests = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_key" in line]
    # both sides of the join, the cache's distinct keys, and the keys of heavy cells
    assert len(of_requests) <= 4
    counts, cells = sketched_counts(requests, ["url"])
    assert counts.count() <= 7000 and cells.count() <= 7000
    # of keys that are all light, none is counted by itself
    assert sketched_counts(spark.range(ROWS), ["id"])[0].count() == 0
