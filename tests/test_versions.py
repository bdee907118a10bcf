import random
import subprocess

from pyspark.sql import functions as F

from tidemark.functions.versions import is_version, version_key
from tidemark.operators.versions import distinct_versions, latest_version, version_sort

ORDERED = [
    "2.12.18", "3.2.9", "3.9.0", "3.11", "3.13.0~rc1", "3.13.0", "3.13.0a2", "3.13.0b1", "3.13.0rc1",
    "3.13.0rc10", "3.13.0-dev", "3.13.0.1", "3.13.1", "3.100.0", "7.3.9", "7.3.10", "7.3.10a1",
    "7.3.10-beta1", "7.3.10-beta2", "11.0.29+7", "11.0.29+10",
]


def frame(spark, versions):
    return spark.createDataFrame([(i, "g", v) for i, v in enumerate(versions)], "id long, g string, v string")


def in_order(spark, versions):
    df = frame(spark, versions).where(is_version(F.col("v")))
    return [row.v for row in df.orderBy(version_key(F.col("v"))).collect()]


def test_natural_order(spark):
    shuffled = ORDERED[:]
    random.Random(1).shuffle(shuffled)
    assert in_order(spark, shuffled) == ORDERED


def test_order_is_that_of_the_sort_command(spark):
    pick = random.Random(7)
    versions = {
        ".".join(str(pick.choice([0, 1, 2, 9, 10, 11, 100])) for _ in range(pick.choice([2, 3, 4])))
        + pick.choice(["", "", "a1", "b2", "rc1", "rc10", "-beta1", "-rc2", "+7", "~x"])
        for _ in range(400)
    }
    text = "\n".join(versions) + "\n"
    out = subprocess.run(["sort", "-V"], input=text, capture_output=True, text=True, env={"LC_ALL": "C"})
    assert in_order(spark, sorted(versions)) == out.stdout.split()


def test_long_numbers_in_the_order_of_the_sort_command(spark):
    pick = random.Random(8)
    number = lambda: "0" * pick.choice([0, 0, 1, 5]) + "".join(pick.choice("0123456789") for _ in range(pick.randint(1, 60)))
    versions = {".".join(number() for _ in range(pick.choice([1, 2, 3]))) + pick.choice(["", "", "a1", "-rc", "~x"]) for _ in range(300)}
    versions |= {f"1.{'9' * n}" for n in range(1, 61)} | {f"1.1{'0' * n}" for n in range(60)}
    out = subprocess.run(["sort", "-V"], input="\n".join(versions) + "\n", capture_output=True, text=True, env={"LC_ALL": "C"})
    assert in_order(spark, sorted(versions)) == out.stdout.split()


def test_words_are_no_versions(spark):
    assert in_order(spark, ["latest", "", "v2.0.0", "2"]) == ["2"]


def test_a_version_with_a_stamp_counts(spark):
    assert latest(spark, ["1.0.0.12345678901234567890", "1.0.0.12345678901234567889"], "stable_first") == "1.0.0.12345678901234567890"


def latest(spark, versions, policy):
    out = latest_version(frame(spark, versions), ["g"], "v", policy).collect()
    return out[0].v if out else None


def test_policies(spark):
    mixed = ["3.12.1", "3.12.0", "3.13.0a2", "3.9.9", "3.14.0-dev"]
    assert latest(spark, mixed, "preview_first") == "3.13.0a2"
    assert latest(spark, mixed, "stable_first") == "3.12.1"
    only_stable = ["3.9.0", "3.10.0"]
    assert latest(spark, only_stable, "preview_first") == "3.10.0"
    only_suffixed = ["7.3.9-x1", "7.3.10-x1"]
    assert latest(spark, only_suffixed, "preview_first") is None
    assert latest(spark, only_suffixed, "stable_first") == "7.3.10-x1"


def test_distinct_versions_are_sorted(spark):
    out = distinct_versions(frame(spark, ["1.10", "1.9", "1.10", "1.2"]), ["g"], "v").collect()
    assert [row.v for row in out] == ["1.2", "1.9", "1.10"]


def test_ranks(spark):
    versions = ["1.10.0", "1.9.0", "1.10.0", "1.2.0", "1.10.0rc1", "1.10", "2.0.0", "1.10.2000", "x", None]
    out = version_sort(frame(spark, versions), ["g"], "v", ["id"]).collect()
    assert len(out) == len(versions)
    want = {"1.2.0": 1, "1.9.0": 2, "1.10": 3, "1.10.0": 4, "1.10.0rc1": 5, "1.10.2000": 6, "2.0.0": 7, "x": None, None: None}
    assert {row.v: row["rank"] for row in out} == want
