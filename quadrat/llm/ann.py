"""Approximate nearest neighbours by largest inner product: a navigable small-world graph for each shard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.pairing import best, search_pairs, valid_vectors
from quadrat.llm.store import blocks_for, stage

_WAVE = 512
_FAR = np.float32(-np.inf)


@dataclass
class Graph:
    """Hierarchical navigable small world. ``layers[0]`` has all nodes; each next layer a random share of them.

    A layer is one flat array of neighbours, a row of fixed width for each node, filled up with -1. ``points`` are the
    vectors with one more component that makes all of them equally long, so that the nearest by distance are those
    with the largest inner product; a query has zero there.
    """

    points: np.ndarray
    layers: list[np.ndarray]
    entry: int

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query up to ``ef`` nodes, nearest first, and their scores; -1 fills up."""
        at = np.full((len(queries), 1), self.entry, np.int32)
        for layer in self.layers[:0:-1]:
            at = _beam(self.points, layer, queries, at, 1, 1)[0]
        return _beam(self.points, self.layers[0], queries, at, ef, 4)


def _scores(points: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.einsum("bkd,bd->bk", points[ids], queries)
    found[ids < 0] = _FAR
    return found


def _top(ids: np.ndarray, scores: np.ndarray, n: int, *more: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
    return [np.take_along_axis(x, order, 1) for x in (ids, scores, *more)]


def _beam(points: np.ndarray, layer: np.ndarray, queries: np.ndarray, start: np.ndarray, ef: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: each expands its best open nodes until none of its ``ef`` is open."""
    n = len(queries)
    ids = np.full((n, ef), -1, np.int32)
    ids[:, : min(ef, start.shape[1])] = start[:, :ef]
    scores, done = _scores(points, queries, ids), ids < 0
    seen = np.zeros((n, len(points) + 1), bool)  # the last column is that of -1
    seen[:, -1] = True
    seen[np.arange(n)[:, None], ids] = True
    live = np.arange(n)
    while len(live):
        open_scores = np.where(done[live], _FAR, scores[live])
        pick = np.argsort(-open_scores, axis=1)[:, :expand]
        usable = np.take_along_axis(open_scores, pick, 1) > _FAR
        going = usable[:, 0]
        live, pick, usable = live[going], pick[going], usable[going]
        if not len(live):
            break
        chosen = np.where(usable, ids[live[:, None], pick], -1)
        done[live[:, None], pick] = True
        near = np.sort(np.where(chosen[:, :, None] >= 0, layer[chosen], -1).reshape(len(live), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[live[:, None], near], -1, near)
        keep = max(1, int((near >= 0).sum(1).max()))
        near = -np.sort(-near, axis=1)[:, :keep]
        seen[live[:, None], near] = True
        merged = _top(np.hstack((ids[live], near)), np.hstack((scores[live], _scores(points, queries[live], near))), ef, np.hstack((done[live], near < 0)))
        ids[live], scores[live], done[live] = merged
    return ids, scores


def _diverse(points: np.ndarray, ids: np.ndarray, scores: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (nearest first) those nearer to the node than to any candidate taken before; places
    that stay free go to the nearest of the rest."""
    vectors = points[ids]
    between = np.einsum("bkd,bjd->bkj", vectors, vectors, optimize=True)
    taken = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        closest = np.where(taken, between[:, k, :], _FAR).max(1)
        taken[:, k] = (ids[:, k] >= 0) & (scores[:, k] > closest) & (taken.sum(1) < width)
    order = np.argsort(np.where(ids < 0, 2, ~taken), axis=1, kind="stable")[:, :width]
    out = np.full((len(ids), width), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


def build(vectors: np.ndarray, links: int = 16, ef: int = 64, seed: int = 5) -> Graph:
    """Insert all vectors, in random order and in waves: a wave searches the graph so far for its candidates, compares
    its members with one another, links each to a diverse choice and adds the links back, pruned where a row is full.
    """
    n = len(vectors)
    rng = np.random.default_rng(seed)
    squares = np.einsum("nd,nd->n", vectors, vectors)
    points = np.hstack((vectors, np.sqrt(np.maximum(0, squares.max(initial=0) - squares))[:, None])).astype(np.float32)
    level = np.minimum(6, np.floor(-np.log(1 - rng.random(n)) / np.log(links)).astype(int))
    order = rng.permutation(n).astype(np.int32)
    order = np.concatenate((order[[level[order].argmax()]], np.delete(order, level[order].argmax())))
    entry, top = int(order[0]), int(level[order[0]])
    layers = [np.full((n, links * (1 + (i == 0))), -1, np.int32) for i in range(top + 1)]
    graph, at = Graph(points, layers, entry), 1
    while at < n:
        wave = order[at : at + min(_WAVE, max(16, at))]
        at += len(wave)
        start = np.full((len(wave), 1), entry, np.int32)
        for i in range(top, -1, -1):
            mine = np.flatnonzero(level[wave] >= i)
            if i and len(mine) < len(wave):
                rest = np.flatnonzero(level[wave] < i)
                first = _beam(points, layers[i], points[wave[rest]], start[rest, :1], 1, 1)[0]
            if len(mine):
                who = wave[mine]
                ids, scores = _beam(points, layers[i], points[who], start[mine], ef, 4)
                peers = points[who] @ points[who].T
                np.fill_diagonal(peers, _FAR)
                together = _top(np.hstack((ids, np.broadcast_to(who, peers.shape))), np.hstack((scores, peers)), ef)
                together[0][together[1] == _FAR] = -1
                layers[i][who] = _diverse(points, *together, links)[:, : layers[i].shape[1]] if i else np.pad(_diverse(points, *together, links), ((0, 0), (0, links)), constant_values=-1)
                _link_back(points, layers[i], who)
            if i:
                following = np.full((len(wave), 1), entry, np.int32)
                if len(mine):
                    following[mine, 0] = ids[:, 0]
                if len(mine) < len(wave):
                    following[rest] = first
                start = following
    return graph


def _link_back(points: np.ndarray, layer: np.ndarray, sources: np.ndarray) -> None:
    targets = layer[sources].ravel()
    ends, targets = np.repeat(sources, layer.shape[1])[targets >= 0], targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    ends, targets = ends[order], targets[order]
    nodes, first, counts = np.unique(targets, return_index=True, return_counts=True)
    fresh = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int32)
    fresh[np.repeat(np.arange(len(nodes)), counts), np.arange(len(targets)) - np.repeat(first, counts)] = ends
    for s in range(0, len(nodes), _WAVE):
        part = nodes[s : s + _WAVE]
        both = np.sort(np.hstack((layer[part], fresh[s : s + _WAVE])), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        scores = _scores(points, points[part], both)
        ids, scores = _top(both, scores, max(layer.shape[1], int((both >= 0).sum(1).max())))
        full = (ids >= 0).sum(1) > layer.shape[1]
        layer[part] = ids[:, : layer.shape[1]]
        if full.any():
            layer[part[full]] = _diverse(points, ids[full], scores[full], layer.shape[1])


def nearest(
    embeddings: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 4096, block_rows: int = 2048, links: int = 16, ef: int = 96, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each row whose id is divisible by ``every``: about the ``k`` other rows with the largest inner product.

    All rows are indexed. Equal vectors share one node, which keeps their ``k + 1`` smallest ids: the others can be in
    no result, since ties go to the smaller id. Nodes are dealt to shards of about ``shard_rows`` by a hash, a graph is
    built in each and kept as flat arrays, every block of queries searches every shard, and the best of all shards are
    merged. What the graphs find is scored again in double precision on the original vectors. The larger ``ef``, the
    more true neighbours are found; a test measures the share against brute force.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part; shorter vectors count as
    zero beyond their end. Rows with a null id take no part; a repeated id counts once, with its smallest vector. An
    empty table gives an empty result.

    Returns ``(query_id long, rank int, vec_id long, score double)``.
    """
    rows = stage(valid_vectors(embeddings, key, vector, zeros=False), "vectors")
    same = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    nodes = stage(kept.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    shard_count, block_count = blocks_for(nodes.count(), shard_rows), blocks_for(queries.count(), block_rows)

    def matrix(column: pa.ChunkedArray, dims: int = 0) -> np.ndarray:
        lists = column.combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(sizes), max(dims, sizes.max(initial=0))))
        out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def index(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.array([i[0] for i in table["ids"].to_pylist()]))))
        vectors = matrix(table["vec"])
        graph = build(vectors, links)
        ids = table["ids"].combine_chunks()
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                "dims": pa.array([vectors.shape[1]], pa.int32()),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
                "ids": pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()),
                "counts": pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()], pa.binary()),
                "layers": pa.array([[layer.tobytes() for layer in graph.layers]], pa.list_(pa.binary())),
                "entry": pa.array([graph.entry], pa.int32()),
            }
        )

    def search(q: pa.Table, shard: pa.Table) -> pa.Table:
        out = {"query_id": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
        if q.num_rows and shard.num_rows:
            row = shard.to_pylist()[0]
            vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dims"])
            counts = np.frombuffer(row["counts"], np.int32)
            ids, firsts = np.frombuffer(row["ids"], np.int64), np.concatenate(([0], np.cumsum(counts)))
            squares = np.einsum("nd,nd->n", vectors, vectors)
            points = np.hstack((vectors, np.sqrt(np.maximum(0, squares.max() - squares))[:, None])).astype(np.float32)
            layers = [np.frombuffer(x, np.int32).reshape(len(points), -1) for x in row["layers"]]
            graph = Graph(points, layers, row["entry"])
            asked, names = matrix(q["vec"], row["dims"])[:, : row["dims"]], q["vec_id"].to_numpy()
            for at in range(0, len(asked), _WAVE):
                part = asked[at : at + _WAVE]
                found = graph.search(np.hstack((part, np.zeros((len(part), 1)))).astype(np.float32), ef)[0]
                exact = np.einsum("bkd,bd->bk", vectors[found], part)
                for query, near, score in zip(names[at : at + _WAVE], found, exact, strict=True):
                    near, score = near[near >= 0], score[near >= 0]
                    rows_of = np.concatenate([ids[firsts[i] : firsts[i + 1]] for i in near])
                    score = np.repeat(score, counts[near])
                    other = rows_of != query
                    rows_of, score = rows_of[other], score[other]
                    order = np.lexsort((rows_of, -score))[:k]
                    out["query_id"].append(np.full(len(order), query))
                    out["vec_id"].append(rows_of[order])
                    out["score"].append(score[order])
        return pa.table({c: np.concatenate(v) for c, v in out.items()})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shard_count)).cast("int"))
    flat = "shard int, dims int, vectors binary, ids binary, counts binary, layers array<binary>, entry int"
    graphs = stage(dealt.groupBy("shard").applyInArrow(index, flat), "graphs")
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(block_count)).cast("int"))
    return best(search_pairs(blocks, graphs, shard_count, block_count, search, "query_id long, vec_id long, score double"), k)
