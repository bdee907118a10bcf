import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix_sources
from tidemark.llm.queries import words


def water_filling(sizes, weights, cap):
    total, targets, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        if not open_:
            return [float(cap * s) for s in sizes]
        rate = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if rate * weights[i] > cap * sizes[i]}
        if not over:
            return [float(cap * s) if i in full else rate * weights[i] for i, s in enumerate(sizes)]
        full |= over


def test_targets_and_takes(spark):
    draw = random.Random(1)
    names = ["B", "a", "é", None, "", "zz", "huge"]
    sizes = {"B": 40, "a": 300, "é": 20, None: 100, "": 60, "zz": 5, "huge": 900}
    rows = [(i, s, draw.randint(0, 40)) for i, s in enumerate(s for s in names for _ in range(sizes[s]))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size int")
    got = mix_sources(docs, "doc_id", "source", F.col("size"), F.lit(1.0)).collect()
    assert len(got) == len(rows)
    order = sorted((s for s in names if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    totals = [sum(r[2] for r in rows if r[1] == s) for s in order]
    wanted = dict(zip(order, water_filling(totals, [1 + i % 3 for i in range(len(order))], 3), strict=True))
    for source, total in zip(order, totals, strict=True):
        own = [r for r in got if r.source == source]
        assert {(r.source_size, r.target) for r in own} == {(total, wanted[source])}
        assert abs(sum(r.taken for r in own) - wanted[source]) <= 20
        assert len({r.copies for r in own}) <= 2 and max(r.copies for r in own) <= 3
    again = mix_sources(docs.repartition(7), "doc_id", "source", F.col("size"), F.lit(1.0)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality_counts(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', 'b') as source", "1 as size", "if(id % 2 = 0, 8.0, 0.5) as q")
    taken = mix_sources(docs, "doc_id", "source", F.col("size"), F.col("q"))
    share = {r.good: r.n for r in taken.where("source = 'b' and copies > 0").groupBy((F.col("doc_id") % 2 == 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    assert share[True] > 0.9 * 1000 and share[False] < 1700  # 2666 of 3000 words are taken


def test_awkward(awkward, table):
    rows = mix_sources(awkward, "doc_id", "source", words(F.col("text"))).collect()
    assert len(rows) == awkward.count()
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mix_sources(awkward.where("false"), "doc_id", "source", F.lit(1)).count() == 0
    (row,) = mix_sources(table((1, None)), "doc_id", "source", words(F.col("text"))).collect()
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)


@pytest.mark.parametrize("text, n", [("a b c\td", 3), ("", 0), (None, 0), ("\x0b\x0c x \r\n", 1), ("\x1c", 1)])
def test_words(table, text, n):
    assert table((1, text)).select(words(F.col("text"))).first()[0] == n
