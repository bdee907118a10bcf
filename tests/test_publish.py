import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.scratch import scratch_path
from tidemark.sources import commits, publish
from tidemark.sources.tables import read_documents


@pytest.fixture
def rules(spark):
    return {"positive": F.col("n") > 0}


def frame(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n long")


def numbers(df):
    return sorted((r.n for r in df.collect()), key=repr)


def test_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.write_table(frame(spark, 1), path, "create_if_absent")
    publish.write_table(frame(spark, 2), path, "append")
    assert numbers(publish.write_table(frame(spark, 9), path, "create_if_absent")) == [1, 2]
    assert numbers(publish.write_table(frame(spark, 3), path, "overwrite")) == [3]
    with pytest.raises(ValueError):
        publish.write_table(frame(spark, 3), path, "ignore")


def test_a_table_rewritten_from_itself_keeps_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    before = publish.write_table(frame(spark, *range(10)), path, "overwrite")
    kept = publish.write_table(before.where("n > 2"), path, "overwrite")
    assert numbers(kept) == list(range(3, 10)) and numbers(before) == list(range(10))
    publish.snapshot_history(frame(spark, 1, 2), str(tmp_path / "s"), 100)
    states = publish.history(spark, str(tmp_path / "s"))
    again = publish.snapshot_history(states.where("n > 1").drop("snapshot_ts"), str(tmp_path / "s"), 100)
    assert numbers(again) == [2] and numbers(states) == [1, 2]
    assert dict(again.dtypes)["snapshot_ts"] == "bigint"


def test_what_was_not_pointed_to_does_not_count(spark, tmp_path):
    """A run that was cut off after writing leaves no trace in results."""
    path = str(tmp_path / "t")
    publish.write_table(frame(spark, 1), path, "overwrite")
    frame(spark, 7).write.parquet(f"{path}/data/v=1")
    assert numbers(publish.published(spark, path)) == [1]
    assert numbers(publish.write_table(frame(spark, 2), path, "overwrite")) == [2]


def test_publish_keeps_the_old_version_when_rules_break(spark, rules, tmp_path):
    root = str(tmp_path / "p")
    assert publish.published_version(spark, root) is None
    with pytest.raises(ValueError):
        publish.validated_publish(frame(spark, -1), rules, root, 1)
    assert numbers(publish.validated_publish(frame(spark, 1, 2), rules, root, 2)) == [1, 2]
    assert numbers(publish.validated_publish(frame(spark, 5, -1), rules, root, 3)) == [1, 2]
    assert numbers(publish.validated_publish(frame(spark, 5, None), rules, root, 4)) == [1, 2]
    # from the published table itself into the next version
    grown = publish.published(spark, root).withColumn("n", F.col("n") + 10)
    assert numbers(publish.validated_publish(grown, rules, root, 5)) == [11, 12]
    # a replay of an old version changes nothing
    assert numbers(publish.validated_publish(frame(spark, 7), rules, root, 5)) == [11, 12]
    assert publish.published_version(spark, root) == 5


def test_snapshots_restore_the_whole_state(spark, tmp_path):
    path = str(tmp_path / "s")
    publish.snapshot_history(frame(spark, 1, 2, 3), path, 100)
    publish.snapshot_history(frame(spark, 2, 4), path, 200)
    history = publish.snapshot_history(frame(spark, 2, 4), path, 200)  # doing it twice
    assert history.count() == 5
    assert numbers(publish.snapshot_latest(history, 199)) == [1, 2, 3]
    assert numbers(publish.snapshot_latest(history, 200)) == [2, 4]
    assert numbers(publish.snapshot_latest(history, 99)) == []


class Session:
    """As much of a session as scratch_path looks at."""

    def __init__(self, master, **settings):
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_follows_the_setting():
    shared = {"spark.checkpoint.dir": "hdfs:///shared/place/"}
    assert scratch_path(Session("yarn", **shared), "x").startswith("hdfs:///shared/place/x-")
    assert scratch_path(Session("local[2]"), "x").startswith(tempfile.gettempdir() + "/")
    with pytest.raises(ValueError):
        scratch_path(Session("yarn"), "x")


def test_documents(spark, tmp_path):
    (tmp_path / "a.conf").write_text("x 1\ny 2\n")
    out = read_documents(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in out] == [("a.conf", "x 1\ny 2\n")]


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def test_a_failed_or_repeated_append_leaves_no_half_table(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.write_table(frame(spark, 1), path, "overwrite")
    broken = frame(spark, 2, 3).withColumn("n", F.when(F.col("n") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        publish.write_table(broken, path, "append")
    assert numbers(publish.published(spark, path)) == [1]
    assert numbers(publish.write_table(frame(spark, 2, 3), path, "append")) == [1, 2, 3]
    with pytest.raises(ValueError):
        publish.write_table(frame(spark, 2).withColumnRenamed("n", "m"), path, "append")


def test_a_candidate_is_not_read_before_it_is_published(spark, rules, tmp_path, monkeypatch):
    reads = []
    monkeypatch.setattr(publish, "_folders", lambda *a: reads.append(commits.numbers(spark, a[1])) or frame(spark))
    root = str(tmp_path / "p")
    publish.validated_publish(frame(spark, 1, 2), rules, root, 1)
    publish.validated_publish(frame(spark, 1, -2), rules, root, 2)
    assert reads == [[0], [0]]  # only to return the version in force


def as_of(states, ts):
    return sorted((tuple(r) for r in publish.state_as_of(states, ts).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_like_full_copies(spark, tmp_path, seed):
    """Random states with changes, deletes and returns, null keys and values: each is restored whole."""
    draw = random.Random(seed)
    root, copies, state = str(tmp_path / "h"), {}, {}
    for step in range(7):
        for k in draw.sample([None, *range(9)], 4):
            if k in state and draw.random() < 0.5:
                del state[k]
            else:
                state[k] = draw.choice(["a", "b", None])
        copies[100 + 10 * step] = sorted(state.items(), key=repr)
        states = publish.interval_history(pairs(spark, *state.items()), root, ["k"], 100 + 10 * step)
    for ts, rows in copies.items():
        assert as_of(states, ts) == as_of(states, ts + 9) == rows
    assert as_of(states, 99) == []
    # rows are kept once for as long as they do not change
    assert states.count() < sum(map(len, copies.values()))
    for ts in (160, 120):
        with pytest.raises(ValueError):
            publish.interval_history(pairs(spark), root, ["k"], ts)
    with pytest.raises(ValueError):
        publish.interval_history(frame(spark, 1), root, ["n"], 900)
    publish.interval_history(pairs(spark), root, ["k"], 900)
    assert as_of(publish.intervals(spark, root), 900) == [] and as_of(publish.intervals(spark, root), 899) == copies[160]
    commits.clean(spark, root, -1)
    assert as_of(publish.intervals(spark, root), 125) == copies[120]
