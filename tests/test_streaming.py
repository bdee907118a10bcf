import pytest
from pyspark.sql import functions as F

from tidemark.operators.sync import sync_apply
from tidemark.plans.queries import QUERIES
from tidemark.sources import commits
from tidemark.streaming import incremental
from tidemark.streaming.incremental import (
    arrivals,
    fold_batches,
    folded_target,
    start_target,
    stream_insert_if_absent,
    stream_insert_within_delay,
    stream_sync_apply,
    stream_synced,
    taken_up,
)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet")


@pytest.fixture
def stream(spark, events, tmp_path):
    """The events as three files of one stream, one per batch."""
    path = str(tmp_path / "in")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, path):
    query = (
        df.writeStream.format("parquet").option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def test_first_of_each_key_once(spark, events, stream, tmp_path):
    out = str(tmp_path / "out")
    query = run(stream_insert_if_absent(stream, ["props"], ["event_id"]), out)
    assert len(query.recentProgress) >= 3
    got = [r.props for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {r.props for r in events.select("props").distinct().collect()}
    # a second run finds nothing new
    run(stream_insert_if_absent(stream, ["props"], ["event_id"]), out)
    assert spark.read.parquet(out).count() == len(got)


def test_late_rows_and_existing_ones(spark, tmp_path):
    """However late its first row is, a key comes through once; one that is there, null too, does not."""
    path = str(tmp_path / "in")
    for batch in (["a", "b"], ["b", "z"], ["late", "a", None]):
        spark.createDataFrame([(k, i) for i, k in enumerate(batch)], "k string, n long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(path)
    existing = spark.createDataFrame([("z",), (None,)], "k string")
    run(stream_insert_if_absent(stream, ["k"], ["n"], existing), str(tmp_path / "out"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "late"]


def test_synced_as_in_one_batch(spark, events, stream, tmp_path):
    deltas, checkpoint = str(tmp_path / "deltas"), str(tmp_path / "checkpoint")
    columns, key, order = ["user_id", "value", "ts", "event_id"], ["user_id"], ["ts", "event_id"]
    target = events.select(*columns).where("user_id < 5").withColumn("user_id", F.col("user_id") - 3)
    target = target.groupBy("user_id").agg(*[F.max(c).alias(c) for c in columns[1:]])
    stream_sync_apply(stream.select(*columns), deltas, checkpoint, key, order).awaitTermination()
    got = stream_synced(spark, target, deltas, key, order)
    last = events.groupBy("user_id").agg(F.max_by(F.struct(*columns[1:]), F.struct(*order)).alias("r"))
    want = sync_apply(last.select("user_id", "r.*"), target, key, "additive")
    expected = sorted(map(repr, want.collect()))
    assert sorted(map(repr, got.collect())) == expected
    assert commits.numbers(spark, deltas) == [0, 1, 2]


def test_replays_and_half_batches_change_nothing(spark, tmp_path):
    deltas, key, order = str(tmp_path / "deltas"), ["k"], ["n"]
    target = spark.createDataFrame([(1, 0), (2, 0)], "k long, n long")
    assert stream_synced(spark, target, deltas, key, order).count() == 2  # before the first batch
    path = str(tmp_path / "in")
    spark.createDataFrame([(2, 5), (3, 5)], "k long, n long").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("k long, n long").parquet(path)
    stream_sync_apply(stream, deltas, str(tmp_path / "one"), key, order).awaitTermination()
    synced = stream_synced(spark, target, deltas, key, order)
    # the same batch once more, as after a lost checkpoint, and a folder that was never pointed to
    stream_sync_apply(stream, deltas, str(tmp_path / "two"), key, order).awaitTermination()
    spark.createDataFrame([(1, 9)], "k long, n long").write.parquet(f"{deltas}/data/1-half")
    for df in (synced, stream_synced(spark, target, deltas, key, order)):
        assert sorted(map(tuple, df.collect())) == [(1, 0), (2, 5), (3, 5)]


def test_folded_batches_are_left_out(spark, events, stream, tmp_path):
    root, deltas = str(tmp_path / "target"), str(tmp_path / "deltas")
    columns, key, order = ["user_id", "value", "ts", "event_id"], ["user_id"], ["ts", "event_id"]
    target = events.select(*columns).where("user_id < 5").dropDuplicates(key)
    start_target(target, root, key)
    stream_sync_apply(stream.select(*columns), deltas, str(tmp_path / "checkpoint"), key, order).awaitTermination()
    want = sorted(map(repr, stream_synced(spark, target, deltas, key, order).collect()))
    before, upto = folded_target(spark, root)
    assert upto == -1
    assert sorted(map(repr, fold_batches(spark, root, deltas, order).collect())) == want
    now, upto = folded_target(spark, root)
    assert upto == 2 and before.count() == target.count()
    assert sorted(map(repr, stream_synced(spark, now, deltas, key, order, upto).collect())) == want
    fold_batches(spark, root, deltas, order)  # nothing new
    assert folded_target(spark, root)[1] == 2


def timed(spark, path, *batches):
    """A stream of files (k, second, n), one a batch."""
    n = 0
    for batch in batches:
        rows = [(k, second, n := n + 1) for k, second in batch]
        frame = spark.createDataFrame(rows, "k string, s long, n long")
        frame.select("k", F.timestamp_seconds("s").alias("ts"), "n").coalesce(1).write.mode("append").parquet(path)
    schema = "k string, ts timestamp, n long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_first_rows_are_put_aside_and_taken_up(spark, tmp_path):
    root, path = str(tmp_path / "root"), str(tmp_path / "in")
    stream = timed(
        spark, path,
        [("a", 1000), ("b", 1001), ("a", 1002)],
        [("c", 2000), (None, 2000), ("a", 2000)],
        [("late", 5), ("b", 7), ("d", 2001), ("d", 2002), ("no time", None), (None, 2001)],
    )
    query = stream_insert_within_delay(stream, ["k"], "ts", 60, root, str(tmp_path / "c"), ["n"])
    query.awaitTermination()
    late = [r.k for r in arrivals(spark, root, "late").collect()]
    inserted = [r.k for r in arrivals(spark, root, "inserted").collect()]
    assert {"late", "b", "no time"} <= set(late) and "d" not in late
    assert inserted.count("d") == 1 and inserted.count(None) == 1 and not {"late", "no time"} & set(inserted)
    existing = spark.createDataFrame([("c",)], "k string")
    assert sorted((r.k for r in taken_up(spark, root, existing, ["k"]).collect()), key=repr) == sorted(
        ["a", "b", "c", "d", "late", "no time", None], key=repr
    )
    # again with the same batches, as after a lost checkpoint: they have their numbers already
    before = commits.numbers(spark, root)
    stream_insert_within_delay(stream, ["k"], "ts", 60, root, str(tmp_path / "c2"), ["n"]).awaitTermination()
    assert commits.numbers(spark, root)[: len(before)] == before
    assert sorted(r.k or "" for r in arrivals(spark, root, "inserted").collect()) == sorted(k or "" for k in inserted)


def test_the_state_stays_bounded(spark, tmp_path):
    """Twelve batches of new keys, an hour apart: the state holds those of the last delays, not all."""
    path, keys = str(tmp_path / "in"), 50
    batches = [[(f"{b}-{i}", 3600 * b + i) for i in range(keys)] for b in range(12)]
    root = str(tmp_path / "root")
    query = stream_insert_within_delay(timed(spark, path, *batches), ["k"], "ts", 600, root, str(tmp_path / "c"), ["n"])
    query.awaitTermination()
    held = [max(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 3 * keys
    assert taken_up(spark, root, spark.createDataFrame([], "k string"), ["k"]).count() == 12 * keys
    assert arrivals(spark, str(tmp_path / "none"), "late") is None
    one = spark.createDataFrame([("x",)], "k string")
    assert taken_up(spark, str(tmp_path / "none"), one, ["k"]).count() == 1


def test_folding_rewrites_touched_buckets_and_folded_batches_go(spark, tmp_path):
    root, deltas, key, order = str(tmp_path / "t"), str(tmp_path / "d"), ["k"], ["n"]
    start_target(spark.createDataFrame([(i, 0) for i in range(100)], "k long, n long"), root, key, 16)
    path = str(tmp_path / "in")
    spark.createDataFrame([(2, 5), (300, 5)], "k long, n long").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("k long, n long").parquet(path)
    stream_sync_apply(stream, deltas, str(tmp_path / "c"), key, order).awaitTermination()
    _, before = commits.latest(spark, root)
    fold_batches(spark, root, deltas, order)
    _, after = commits.latest(spark, root)
    assert 1 <= sum(after["buckets"][b] != before["buckets"].get(b) for b in after["buckets"]) <= 2
    target, upto = folded_target(spark, root)
    want = sorted([(i, 0) for i in range(100) if i != 2] + [(2, 5), (300, 5)])
    assert sorted(map(tuple, target.collect())) == want
    assert len(commits.forget(spark, deltas, upto, -1)) == 2 and commits.numbers(spark, deltas) == []
    assert sorted(map(tuple, stream_synced(spark, target, deltas, key, order, upto).collect())) == want


def test_batches_of_the_query_do_not_grow_with_its_files(spark, events, tmp_path, monkeypatch):
    """What tasks send to the driver grows with batches times partitions of the state: three batches, however many files."""
    events.repartition(24).write.parquet(str(tmp_path / "events.parquet"))
    queries = []

    def started(*arguments):
        queries.append(stream_insert_within_delay(*arguments))
        return queries[-1]

    monkeypatch.setattr(incremental, "stream_insert_within_delay", started)
    got = QUERIES["stream_insert_within_delay"](spark, str(tmp_path)).collect()
    assert sorted(r.props for r in got) == sorted(r.props for r in events.select("props").distinct().collect())
    taken = [p["numInputRows"] for p in queries[0].recentProgress if p["numInputRows"]]
    # both branches of the query read each batch
    assert len(taken) == 3 and sum(taken) == 2 * events.count()
