"""Exact top-k search by integer inner product, a term at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.pairing import best, search_pairs, valid_vectors
from quadrat.llm.store import blocks_for, stage

_TILE = 64  # queries that share a pass over the postings
_LONG = (1 << 63) - 1


def postings(ids: np.ndarray, owners: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(term, places, weights)`` for each term: which of ``ids`` (sorted) have it, and with what weight."""
    order = np.lexsort((owners, terms))
    terms, owners, weights = terms[order], np.searchsorted(ids, owners[order]), weights[order]
    cuts = [0, *(np.flatnonzero(np.diff(terms)) + 1).tolist(), len(terms)]
    return [(int(terms[s]), owners[s:e], weights[s:e]) for s, e in zip(cuts, cuts[1:], strict=False) if e > s]


def accumulate(lists, rows: int, queries: dict[int, tuple[np.ndarray, np.ndarray]], width: int, kind) -> np.ndarray:
    """Scores of ``width`` queries over all rows of a shard: each posting list is scattered, weighted with each query
    that has its term, into a dense array with a line for each row."""
    scores = np.zeros((rows, width), kind)
    for term, places, weights in lists:
        if term in queries:
            which, of_query = queries[term]
            if len(which) * 2 >= width:  # whole lines at once; queries without the term add nothing
                line = np.zeros(width, kind)
                line[which] = of_query
                scores[places] += weights[:, None] * line
            else:
                scores[np.ix_(places, which)] += weights[:, None] * of_query
    return scores


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = 4096, block_rows: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: the ``k`` other rows with the highest inner product of the
    vectors ``floor(scale * x)``.

    Vectors become sparse rows (term, weight) without zeros. Rows are dealt to shards by their id, queries to blocks;
    a shard keeps a posting list for each term. For a tile of queries the lists are scattered one term after another
    into dense score arrays, the ``k`` best of a shard are selected by partition, and those of all shards are merged.
    Every row is scored, rows that share no term with a query at 0. Scores are summed in 32-bit integers where the
    weights prove that enough, else in 64-bit ones, else in unbounded ones whose results are held within the range of
    a long.

    Vectors that are null or hold a null or non-finite component take no part; zero vectors and empty ones do. Vectors of
    different lengths are compared over the terms that both have. Rows with a null id take no part; a repeated id
    counts once, with its smallest vector. An empty table gives an empty result.

    Returns ``(query_id long, rank int, vec_id long, score long)``.
    """
    rows = valid_vectors(embeddings, key, vector, zeros=True)
    rows = stage(rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec")), "weights")
    count = rows.count()
    shard_count, queries = blocks_for(count, shard_rows), rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    block_count = blocks_for(queries.count(), block_rows)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by("vec_id").combine_chunks()
        ids, vecs = table["vec_id"].to_numpy(), table["vec"].combine_chunks()
        sizes = np.diff(vecs.offsets.to_numpy())
        values = vecs.flatten().to_numpy(zero_copy_only=False)
        owners = np.repeat(ids, sizes)
        terms = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = values != 0
        return ids, owners[kept], terms[kept], values[kept]

    def search(q: pa.Table, shard: pa.Table) -> pa.Table:
        ids, owners, terms, weights = sparse(shard)
        asked, q_owners, q_terms, q_weights = sparse(q)
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(ids) and len(asked):
            most = float(np.abs(weights).max(initial=0)) * float(np.abs(q_weights).max(initial=0)) * (max(terms.max(initial=0), q_terms.max(initial=0)) + 1)
            kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object
            as_ints = (lambda w: np.array([int(x) for x in w], object)) if kind is object else (lambda w: w.astype(kind))
            lists = postings(ids, owners, terms, as_ints(weights))
            for at in range(0, len(asked), _TILE):
                tile = asked[at : at + _TILE]
                here = (q_owners >= tile[0]) & (q_owners <= tile[-1])
                by_term = {t: (places, w) for t, places, w in postings(tile, q_owners[here], q_terms[here], as_ints(q_weights[here]))}
                scores = accumulate(lists, len(ids), by_term, len(tile), kind).T
                for query, line in zip(tile.tolist(), np.ascontiguousarray(scores), strict=True):
                    n = min(k + 1, len(line))
                    least = np.sort(line)[-n] if kind is object else np.partition(line, len(line) - n)[len(line) - n]
                    above, level = np.flatnonzero(line > least), np.flatnonzero(line == least)
                    places = np.concatenate((above, level[: n - len(above)]))
                    if query % every == 0 and (own := np.searchsorted(ids, query)) < len(ids) and ids[own] == query:
                        places = np.union1d(places[places != own], level[level != own][: n - len(above)])
                    out["query_id"].append(np.full(len(places), query))
                    out["vec_id"].append(ids[places])
                    out["score"].append(np.clip(line[places], -_LONG - 1, _LONG).astype(np.int64))
        return pa.table({c: np.concatenate([np.empty(0, np.int64), *v]) for c, v in out.items()})

    shards = rows.withColumn("shard", deal(shard_count))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(block_count)).cast("int"))
    found = search_pairs(blocks, shards, shard_count, block_count, search, "query_id long, vec_id long, score long")
    return best(found, k)
