import re

from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators.filters import rule_check


def test_host_labels(spark):
    names = [
        "a", "worker-1", "A9", "", "-a", "a-", "a_b", "a.b", "a" * 63, "a" * 64, "a" + "-" * 61 + "b",
        "a" + "-" * 62 + "b", "a\n", "é", None,
    ]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = rule_check(df, rules.host_label_rules(F.col("n"))).collect()
    for row in out:
        # fixed values: what a host label may be
        right = row.n is not None and re.fullmatch("[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?", row.n)
        assert row.valid == bool(right), row
        assert row.valid == (row.violations == [])
    broken = {row.n: row.violations for row in out}
    assert broken["a-"] == ["last_is_alphanumeric"]
    assert broken["a" * 64] == ["length_within_limit"]
    assert broken[""] == ["not_empty", "first_is_alphanumeric", "last_is_alphanumeric"]


def test_versions_and_networks(spark):
    df = spark.createDataFrame([("3.11",), ("3.11.0",), ("3.11\n",), ("3.11rc",), ("10.0.0.0/8",), ("10.0.0.0",)], "v string")
    valid = lambda checks: [r.v for r in rule_check(df, checks).where("valid").collect()]
    assert valid(rules.version_rules(F.col("v"), 2)) == ["3.11"]
    assert valid(rules.version_rules(F.col("v"), 3)) == ["3.11.0"]
    assert valid(rules.network_rules(F.col("v"))) == ["10.0.0.0/8"]
