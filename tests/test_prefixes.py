import random
import re

import pytest

from tidemark.operators import spread
from tidemark.operators.filters import exclude_pattern_filter, exclude_prefix_table, longest_prefix


@pytest.fixture(params=[100_000, 2])
def broadcast(request, monkeypatch):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", request.param)


def test_like_the_regexp_form(spark, broadcast):
    """Thousands of prefixes with characters that a regexp would read otherwise, some within others."""
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("ab.é(*") for _ in range(draw.randrange(1, n)))
    prefixes = sorted({word(9) for _ in range(3000)})
    values = [word(14) for _ in range(400)] + ["", None, None, "ab"]
    rows = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    table = spark.createDataFrame([(p,) for p in [*prefixes, None, prefixes[0]]], "p string")
    got = longest_prefix(rows, "v", table, "found", ["n"]).collect()
    assert len(got) == len(values)
    for r in got:
        fitting = [p for p in prefixes if r.v is not None and r.v.startswith(p)]
        assert r.found == (max(fitting, key=len) if fitting else None)
    kept = exclude_prefix_table(rows, "v", table, ["n"])
    want = exclude_pattern_filter(rows, "v", [re.escape(p) for p in prefixes])
    assert kept.columns == rows.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want.collect()))
    assert "rlike" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()


def test_empty_and_clashing(spark, broadcast):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "_prefix int, _value string")
    none, every = spark.createDataFrame([], "p string"), spark.createDataFrame([("",)], "p string")
    assert exclude_prefix_table(rows, "_value", none).count() == 2
    got = {r._prefix: r.found for r in longest_prefix(rows, "_value", every, "found").collect()}
    assert got == {1: "", 2: None}
    assert exclude_prefix_table(rows, "_value", every).columns == rows.columns
