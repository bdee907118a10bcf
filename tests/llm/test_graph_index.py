import math

import numpy as np
import pytest

from tidemark.llm import graph_index
from tidemark.llm.graph_index import build_graph, greedy_search, nearest_neighbours, robust_prune


def exact(rows, every, k):
    out = {}
    for query, vector in rows:
        if query % every == 0:
            found = sorted((math.dist(vector, v), i) for i, v in rows if i != query)
            out[query] = found[:k]
    return out


def frame(spark, rows, schema="vec_id long, embedding array<double>, score int, id int, shard string"):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [2, 0], [0, 3], [-5, 0]], np.float32)
    got = robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, -1, 1, 0]]), 3, 1.0)
    assert got.tolist() == [[1, 3, 4]]  # 2 is nearer to 1


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs_find_all(n):
    points = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
    graph = build_graph(points)
    found, far = greedy_search(graph, points, 128)
    assert (found[:, 0] == np.arange(n)).all() and ((found >= 0).sum(axis=1) == n).all()
    assert (np.diff(far[:, :n], axis=1) >= 0).all()


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "QUERY_BLOCK", 16)  # several blocks
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(20, 32))
    points = centres[draw.integers(0, 20, 3000)] + 0.4 * draw.normal(size=(3000, 32))
    rows = [(i, [float(x) for x in p.astype(np.float32)]) for i, p in enumerate(points)]
    got = nearest_neighbours(frame(spark, rows), "vec_id", "embedding", shard_rows=1000).collect()
    want = exact(rows, 100, 10)
    assert len(got) == 10 * len(want)
    hits = 0
    for query, near in want.items():
        own = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(abs(r.score - math.dist(rows[query][1], rows[r.vec_id][1])) < 1e-12 for r in own)
        hits += len({i for _, i in near} & {r.vec_id for r in own})
    assert hits / len(got) >= 0.95


def test_copies_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 500)] + [(500, [1.0, 2.5]), (501, [0.0, 0.0]), (502, [nan, 1.0]), (503, [inf, 1.0]), (504, None),
            (505, [None, 1.0]), (506, [1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0])]
    got = nearest_neighbours(frame(spark, rows), "vec_id", "embedding", k=3, shard_rows=200).collect()
    near = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100, 500)}
    assert near[0] == [(1, 0.0), (2, 0.0), (3, 0.0)] and near[100] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert near[500] == [(0, 0.5), (1, 0.5), (2, 0.5)]
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400, 500}


def test_few_rows(spark):
    assert nearest_neighbours(frame(spark, [(0, [1.0])]).where("false"), "vec_id", "embedding").count() == 0
    assert nearest_neighbours(frame(spark, [(0, [1.0])]), "vec_id", "embedding").count() == 0
    got = nearest_neighbours(frame(spark, [(0, [1.0]), (3, [4.0]), (5, [2.0])]), "vec_id", "embedding").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 5, 1.0), (0, 2, 3, 3.0)]
