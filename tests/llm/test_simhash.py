import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.simhash import fingerprint, near_dedup, near_links


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(pairs, items):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "É É x A b\x0bc d", "w " * 70_000, "x y " * 300 + "z"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == signed(slow_fingerprint(text))


def test_hash_is_that_of_spark(spark):
    (row,) = spark.sql("select xxhash64('a b c') as h").collect()
    assert row.h == signed(xxhash.xxh64_intdigest(b"a b c", 42))


def test_links_keep_all_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 100)
    draw, fps = random.Random(3), {0, 7, 15}
    for _ in range(60):
        base = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 20)):
            near = base
            for _ in range(draw.randrange(6)):
                near ^= 1 << draw.randrange(64)
            fps.add(near)
    fps = sorted(map(signed, fps))
    want = roots([(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3], fps)
    links = near_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r.node: r.component for r in components(links).collect()}
    assert {x: got.get(x, x) for x in fps} == want


@pytest.mark.parametrize("half", [0, 1])
def test_a_half_that_most_fingerprints_share(spark, monkeypatch, half):
    """Such a half is cut by as many bits as its load needs: no place has twice the variants of a bucket, no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    draw, fps = random.Random(8 + half), set()
    for size in (1200, 150, 40, 20):
        kept, base = draw.getrandbits(32), draw.getrandbits(32)
        while size:
            other = base if size % 2 else draw.getrandbits(32)
            for _ in range(draw.randrange(5)):
                other ^= 1 << draw.randrange(32)
            number = kept << 32 | other if half else other << 32 | kept
            size -= number not in fps
            fps.add(number)
    fps = sorted(map(signed, fps))
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    got = {r.node: r.component for r in components(near_links(table)).collect()}
    assert {x: got.get(x, x) for x in fps} == roots(near, fps)
    assert {r._bits for r in simhash.hot_halves(table).collect()} >= {2, 4, 8}
    even = [x for x in fps if x.bit_count() % 2 == 0]
    around = {x ^ f for x in fps for f in simhash.ONE_FLIP if (x ^ f).bit_count() % 2 == 0}
    near = spark.createDataFrame([(v, v) for v in around], "variant long, least long")
    far, near = simhash.meeting(spark.createDataFrame([(x,) for x in even], "fp long"), near, table)
    assert near.groupBy(*simhash.PLACE).count().agg(F.max("count")).first()[0] <= 2 * 33 * simhash.BUCKET
    # a fingerprint comes to a place once; near copies come to the same places, however their half is cut
    assert far.groupBy(*simhash.PLACE).agg((F.count("fp") - F.count_distinct("fp")).alias("again")).agg(F.max("again")).first()[0] == 0


@pytest.mark.parametrize("bits", simhash.FOLDS)
def test_folded_halves(spark, bits):
    draw = random.Random(bits)
    halves = [0, 1, (1 << 32) - 1, *[draw.getrandbits(32) for _ in range(50)]]
    want = [sum((sum(x >> i & 1 for i in range(k, 32, bits)) % 2) << k for k in range(bits)) for x in halves]
    assert simhash._folded(np.array(halves, np.int64), bits).tolist() == want
    table = spark.createDataFrame([(x,) for x in halves], "x long")
    got = {r.x: r.c for r in table.select("x", simhash._folded(F.col("x"), bits).alias("c")).collect()}
    assert [got[x] for x in halves] == want
    reached = {simhash._folded(np.array([1 << i ^ 1 << j]), bits)[0] for i in range(32) for j in range(i)}
    assert reached == set(simhash._two_changes(bits))


def test_components(spark):
    draw = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(120)]
    df = spark.createDataFrame([*pairs, (500, 500), (None, 3), (160, 99)], "u long, v long")
    nodes = {x for p in [*pairs, (160, 99)] for x in p if p[0] != p[1]}
    want = roots([*pairs, (160, 99)], {x for p in [*pairs, (160, 99)] for x in p})
    assert {r.node: r.component for r in components(df).collect()} == {n: want[n] for n in nodes}
    assert components(df.where("false")).count() == 0


def test_awkward(awkward):
    rows = near_dedup(awkward, "doc_id", "text").collect()
    assert len(rows) == awkward.count()
    component = {}
    for r in rows:
        component.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert component[1] == component[2] == component[3] == {(0, 1)}  # no words: fingerprint 0, linked like any other
    assert {c for _, c in component[5] | component[6]} == {5} and len(component[7]) == 2
    assert near_dedup(awkward.where("false"), "doc_id", "text").count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 9").withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit(" End"))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = roots([(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    got = {r.doc_id: r for r in near_dedup(docs, "doc_id", "text").collect()}
    assert {i: (r.fp, r.component_id) for i, r in got.items()} == {i: (signed(fps[i]), want[i]) for i in fps}
