"""Approximate nearest neighbours over robust-pruned directed graphs, one graph per shard.

A graph starts at random. Each vector in turn (a block of them at a time) is looked for by greedy search;
what the search has met are the candidates for its edges. Robust pruning takes the nearest candidate and
drops those that are nearer to it, by the factor ``alpha``, than to the vector itself; edges are added in
both directions, and a node with too many is pruned again. Queries run a beam search in every shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

DEGREE = 24
SLACK = 10  # edges beyond DEGREE that a node takes before it is pruned again
ALPHA = 1.2
BUILD_BEAM = 40
BLOCK = 256  # vectors that are added to a graph together
SEARCH_BEAM = 128
SHARD_ROWS = 3000  # vectors a shard has on average
QUERY_BLOCK = 512  # queries that search a shard together


@dataclass
class Graph:
    points: np.ndarray  # distinct vectors, float32
    edges: np.ndarray  # row by row, -1 where a node has fewer
    entry: int


def _distances(points: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of ids; -1 is no point."""
    apart = points[ids] - queries[:, None, :]
    found = np.einsum("qkd,qkd->qk", apart, apart)
    found[ids < 0] = np.inf
    return found


def greedy_search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points met by each query, nearest first, and their squared distances.

    All queries take a step together: expand the nearest point of their beam not expanded yet.
    """
    n = len(queries)
    rows = np.arange(n)
    ids = np.full((n, beam), -1)
    far = np.full((n, beam), np.inf)
    ids[:, 0] = graph.entry
    far[:, 0] = _distances(graph.points, queries, ids[:, :1])[:, 0]
    open_ = np.zeros((n, beam), bool)
    open_[:, 0] = True
    met = np.zeros((n, len(graph.points)), bool)
    met[:, graph.entry] = True
    live = rows
    while len(live):
        step = np.argmax(open_[live], axis=1)  # beams are sorted: the first open one is the nearest
        open_[live, step] = False
        new = graph.edges[ids[live, step]]
        new = np.where(met[live[:, None], new], -1, new)
        owner, column = np.nonzero(new >= 0)
        met[live[owner], new[owner, column]] = True
        near = _distances(graph.points, queries[live], new)
        all_far = np.concatenate([far[live], near], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(all_far, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new], axis=1), best, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], new >= 0], axis=1), best, 1)
        live = live[open_[live].any(axis=1)]
    return ids, far


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` edges of each node out of its row of candidates (-1 for none, repeats allowed)."""
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    far = _distances(points, points[nodes], candidates)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    vectors = points[candidates]
    inner = vectors @ vectors.transpose(0, 2, 1)
    squares = np.einsum("ckk->ck", inner)
    between = squares[:, :, None] + squares[:, None, :] - 2 * inner
    rows = np.arange(len(nodes))
    chosen = np.full((len(nodes), degree), -1)
    alive = np.isfinite(far)
    for place in range(degree):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = candidates[rows, first]
        chosen[some, place] = pick[some]
        alive &= (alpha * alpha * between[rows, first] > far) & (candidates != pick[:, None])
    return chosen


def _add_reverse(graph: Graph, source: np.ndarray, target: np.ndarray, degree: int, alpha: float) -> None:
    """Add edges from targets back to sources; a node that has no room for them is pruned."""
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    heads, first, counts = np.unique(target, return_index=True, return_counts=True)
    extra = np.full((len(heads), int(counts.max(initial=0))), -1)
    extra[np.repeat(np.arange(len(heads)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
    room = graph.edges.shape[1]
    for at in range(0, len(heads), BLOCK):
        some = heads[at : at + BLOCK]
        wanted = np.sort(np.concatenate([graph.edges[some], extra[at : at + BLOCK]], axis=1), axis=1)[:, ::-1]
        wanted = np.ascontiguousarray(wanted)
        wanted[:, 1:][wanted[:, 1:] == wanted[:, :-1]] = -1  # an edge that is there already
        full = (wanted >= 0).sum(axis=1) > room
        fits = np.sort(wanted[~full], axis=1)[:, ::-1][:, :room]
        graph.edges[some[~full], : fits.shape[1]] = fits
        graph.edges[some[full]] = -1
        graph.edges[some[full], :degree] = robust_prune(graph.points, some[full], wanted[full], degree, alpha)


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> Graph:
    """A graph over distinct points (float32 rows)."""
    n = len(points)
    random = np.random.default_rng(0)
    start = min(degree // 2, n - 1)
    edges = np.full((n, degree + SLACK), -1)
    if start > 0:
        drawn = random.integers(0, n - 1, (n, start))
        edges[:, :start] = drawn + (drawn >= np.arange(n)[:, None])  # never the node itself
    graph = Graph(points, edges, int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))))
    for relax in (1.0, alpha):
        order = random.permutation(n)
        for at in range(0, n, BLOCK):
            block = order[at : at + BLOCK]
            found, _ = greedy_search(graph, points[block], beam)
            chosen = robust_prune(points, block, np.concatenate([found, edges[block]], axis=1), degree, relax)
            edges[block] = -1
            edges[block, :degree] = chosen
            source, target = np.repeat(block, degree), chosen.ravel()
            _add_reverse(graph, source[target >= 0], target[target >= 0], degree, relax)
    return graph


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as doubles) of rows whose vector is not null or zero and has only finite components."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """Rows of the index: shard, node, id, vector, edges, entry; one graph over each shard's distinct vectors.

    The shard is a hash of the id, so that shards are even whatever the vectors. Copies of a vector are
    further ids of one node: they add no edges. All vectors have to have the same length.
    """

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        points = np.stack(part["vector"].to_numpy())
        distinct, first, node = np.unique(points, axis=0, return_index=True, return_inverse=True)
        graph = build_graph(distinct.astype(np.float32))
        node = node.ravel()
        leads = first[node] == np.arange(len(node))
        edges = [graph.edges[n][graph.edges[n] >= 0].astype(np.int32) if lead else None for n, lead in zip(node, leads, strict=True)]
        return pd.DataFrame(
            {"shard": part["shard"], "node": node.astype(np.int32), "id": part["id"], "vector": part["vector"], "edges": edges,
             "entry": np.int32(graph.entry)}
        )

    schema = "shard int, node int, id long, vector array<double>, edges array<int>, entry int"
    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vector")
    return dealt.groupBy("shard").applyInPandas(work, schema)


def load_graph(rows: pd.DataFrame) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a shard; and sorted by node and id: nodes, ids, vectors of all its rows."""
    rows = rows.sort_values(["node", "id"], kind="stable")
    nodes = rows["node"].to_numpy()
    vectors = np.stack(rows["vector"].to_numpy())
    lead = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    edges = np.full((len(lead), DEGREE + SLACK), -1)
    for row, out in zip(edges, rows["edges"].to_numpy()[lead], strict=True):
        row[: len(out)] = out
    return Graph(vectors[lead].astype(np.float32), edges, int(rows["entry"].iloc[0])), nodes, rows["id"].to_numpy(), vectors


def search_index(index: DataFrame, queries: DataFrame, k: int, shards: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest ids found for each query (id, vector), its own id left out.

    Score is the Euclidean distance in double precision. Queries go to every shard in blocks of about
    QUERY_BLOCK, so that a task holds a shard and a block. Ties go to the smaller id.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shard_list = F.sequence(F.lit(0), F.lit(shards - 1))
    block_list = F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = queries.select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "vector", F.explode(shard_list).alias("shard")
    )
    held = index.withColumn("block", F.explode(block_list))

    def work(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        graph, nodes, ids, vectors = load_graph(shard)
        asked = np.stack(block["vector"].to_numpy())
        found, _ = greedy_search(graph, asked.astype(np.float32), beam)
        starts = np.searchsorted(nodes, np.arange(len(graph.points) + 1))
        out = []
        for query, vector, near in zip(block["id"].to_numpy(), asked, found, strict=True):
            near = near[near >= 0]
            # of copies of a vector the k + 1 smallest ids are enough
            rows = np.concatenate([np.arange(starts[n], min(starts[n + 1], starts[n] + k + 1)) for n in near])
            rows = rows[ids[rows] != query]
            score = np.sqrt(((vectors[rows] - vector) ** 2).sum(axis=1))
            best = np.lexsort((ids[rows], score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[rows][best], "score": score[best]}))
        return pd.concat(out)

    keys = ["shard", "block"]
    pairs = held.groupBy(*keys).cogroup(asked.groupBy(*keys))
    near = pairs.applyInPandas(work, "query_id long, vec_id long, score double").distinct()
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")  # at most k rows of each shard
    ranked = near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, key: str, vector: str, k: int = 10, every: int = 100, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest of all rows to each row whose key is divisible by ``every`` (Euclidean distance).

    Vectors that are null, zero or hold null or non-finite components take no part, neither do rows with a
    null key or a vector of another length than the most frequent one. Rows that repeat a key and a vector
    are one; a key with several vectors is a query for each, and each of its vectors can be found.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors, key, vector).where(F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1)
    length = sizes.first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == length.n).dropDuplicates(["id", "vector"])
    shards = max(1, round(length["count"] / shard_rows))
    index = written(build_index(rows, shards), "vector-index")
    queries = rows.where(F.col("id") % every == 0)
    return search_index(index, queries, k, shards)
