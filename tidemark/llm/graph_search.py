"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams.

Rows are dealt into shards of about ``SHARD`` vectors. In a shard equal vectors share a node. Nodes are inserted in
batches: a greedy search from the medoid proposes neighbours, relaxed distance pruning keeps diverse edges, and edges
back are pruned the same way. Largest inner product becomes least distance by one more component that gives all rows of
a shard the same length. Each query searches each shard by a beam; scores are inner products of the original vectors in
double precision.

Vectors that are null, empty, all zero or hold null or non-finite components take no part; neither do rows without id.
Rows that share an id count as one. Ties go to the smaller id, exactly so among equal vectors. A query meets rows with
as many components as it has. Empty tables give no rows. Other columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.blocks import best, cells, packed, usable
from tidemark.llm.common import stash

#: Vectors of a shard, queries of a block.
SHARD, QUERIES = 8192, 1024
#: Edges of a node, beam widths when building and searching, nodes opened in a step, and how far pruning is relaxed.
DEGREE, BUILD_BEAM, SEARCH_BEAM, OPENED, ALPHA = 32, 64, 128, 4, 1.2
#: Nodes inserted, or queries searched, side by side.
BATCH = 256


def beam_search(queries: np.ndarray, nodes: np.ndarray, edges: np.ndarray, entry: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` best nodes found (ids, similarities; unused places hold the number of nodes).

    nodes: one vector for each node and a last row of zeros; edges: node x degree, unused places (and the last row) hold
    the number of that last row.
    """
    n, q = len(nodes) - 1, len(queries)
    ids = np.full((q, width), n)
    sims = np.full((q, width), -np.inf, np.float32)
    opened = np.zeros((q, width), bool)
    seen = np.zeros((q, n + 1), bool)
    ids[:, 0], sims[:, 0] = entry, queries @ nodes[entry]
    seen[:, [entry, n]] = True
    active = np.arange(q)
    while len(active):
        waiting = np.where(opened[active], -np.inf, sims[active])
        at = np.argpartition(-waiting, min(OPENED, width) - 1, axis=1)[:, :OPENED]
        ready = np.take_along_axis(waiting, at, 1) > -np.inf
        left = ready.any(axis=1)
        active, at, ready = active[left], at[left], ready[left]
        if not len(active):
            break
        mine = active[:, None]
        opened[mine, at] |= ready
        found = np.sort(edges[np.where(ready, ids[mine, at], n)].reshape(len(active), -1), axis=1)
        new = ~seen[mine, found]
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[mine, found] = True
        found = np.where(new, found, n)
        sim = np.matmul(nodes[found], queries[active][:, :, None])[:, :, 0]
        sim[~new] = -np.inf
        all_ids, all_sims = np.concatenate([ids[active], found], 1), np.concatenate([sims[active], sim], 1)
        all_opened = np.concatenate([opened[active], ~new], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active], sims[active], opened[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_opened))
    return ids, sims


def robust_prune(nodes: np.ndarray, points: np.ndarray, proposed: np.ndarray, length: float) -> np.ndarray:
    """DEGREE neighbours at most for each point: the nearest first, without those that a kept one is much nearer to.

    All nodes have the squared length ``length``, so a squared distance is 2 * (length - similarity).
    """
    n = len(nodes) - 1
    proposed = np.sort(proposed, axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = n
    proposed[proposed == points[:, None]] = n
    sim = np.matmul(nodes[proposed], nodes[points][:, :, None])[:, :, 0]
    sim[proposed == n] = -np.inf
    order = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * DEGREE]
    proposed, sim = np.take_along_axis(proposed, order, 1), np.take_along_axis(sim, order, 1)
    own = nodes[proposed]
    between = 2 * (length - np.matmul(own, own.transpose(0, 2, 1)))
    away = 2 * (length - sim)
    alive = proposed < n
    kept = np.full((len(points), DEGREE), n)
    each = np.arange(len(points))
    for i in range(DEGREE):
        j = alive.argmax(axis=1)
        some = alive[each, j]
        if not some.any():
            break
        kept[some, i] = proposed[each, j][some]
        alive &= ALPHA * ALPHA * between[each, j] > away
        alive[each, j] = False
    return kept


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes (with the added component and a last row of zeros), edges and entry of a graph over distinct vectors."""
    n, dim = vectors.shape
    squared = (vectors * vectors).sum(axis=1)
    length = float(squared.max())
    nodes = np.zeros((n + 1, dim + 1), np.float32)
    nodes[:n, :dim], nodes[:n, dim] = vectors, np.sqrt(np.maximum(length - squared, 0))
    entry = int((nodes[:n] @ nodes[:n].mean(axis=0)).argmax())
    dice = np.random.default_rng(n)
    edges = np.full((n + 1, DEGREE), n)
    edges[:n, : DEGREE // 2] = dice.integers(0, n, (n, DEGREE // 2))
    order = dice.permutation(n)
    for at in range(0, n, BATCH):
        points = order[at:at + BATCH]
        near, _ = beam_search(nodes[points], nodes, edges, entry, BUILD_BEAM)
        edges[points] = robust_prune(nodes, points, np.concatenate([near, edges[points]], 1), length)
        start, to = np.repeat(points, DEGREE), edges[points].ravel()
        start, to = start[to < n], to[to < n]
        back = np.argsort(to, kind="stable")
        start, to = start[back], to[back]
        met, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(met), count.max(initial=0)), n)
        more[np.repeat(np.arange(len(met)), count), np.arange(len(to)) - np.repeat(first, count)] = start
        both = np.sort(np.concatenate([edges[met], more], 1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = n
        full = (both < n).sum(axis=1) > DEGREE
        edges[met[~full]] = np.sort(both[~full], axis=1)[:, :DEGREE]
        if full.any():
            edges[met[full]] = robust_prune(nodes, met[full], both[full], length)
    return nodes, edges, entry


def pack(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """A shard: its distinct vectors, the rows of each and the graph."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    _, edges, entry = build(distinct)
    return {"ids": ids[order].astype("<i8").tobytes(), "first": np.searchsorted(node.ravel()[order], np.arange(len(distinct) + 1)).astype("<i8").tobytes(),
            "vectors": distinct.astype("<f8").tobytes(), "edges": edges.astype("<i4").tobytes(), "entry": np.array([entry], "<i8").tobytes()}


def search_shard(shard: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, row ids and scores of the k best found for each query."""
    ids, first = np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["first"], "<i8")
    vectors = np.frombuffer(shard["vectors"], "<f8").reshape(len(first) - 1, -1)
    edges = np.frombuffer(shard["edges"], "<i4").reshape(len(vectors) + 1, -1).astype(np.int64)
    nodes = np.zeros((len(vectors) + 1, vectors.shape[1]), np.float32)
    nodes[:-1] = vectors
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(queries), BATCH):
        found, _ = beam_search(queries[at:at + BATCH].astype(np.float32), nodes, edges, int(np.frombuffer(shard["entry"], "<i8")[0]), max(beam, k + 1))
        for qid, q, near in zip(query_ids[at:at + BATCH], queries[at:at + BATCH], found, strict=True):
            near = near[near < len(vectors)]
            score = (vectors[near] * q).sum(axis=1)
            near, score = (x[np.argsort(-score, kind="stable")] for x in (near, score))
            count = first[near + 1] - first[near]
            rows = np.concatenate([ids[first[i]:first[i + 1]] for i in near])
            score = np.repeat(score, count)
            order = np.lexsort((rows, -score))
            order = order[rows[order] != qid][:k]
            out[0].append(np.full(len(order), qid))
            out[1].append(rows[order])
            out[2].append(score[order])
    return tuple(np.concatenate(x) for x in out)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = SEARCH_BEAM, shard: int = SHARD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k rows found with the largest inner product for each row whose id ``every`` divides."""
    rows = stash(usable(vectors, vec_id, embedding, zero=False))
    # of equal vectors only the k + 1 smallest ids can be among the k first of a query
    copies = W.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    few = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    index = stash(packed(stash(few), shard, pack, "ids binary, first binary, vectors binary, edges binary, entry binary"))
    asked = stash(packed(rows.where(F.pmod("vec_id", F.lit(every)) == 0), QUERIES, lambda ids, v: {"ids": ids.astype("<i8").tobytes(), "v": v.astype("<f8").tobytes()}, "ids binary, v binary"))

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                queries = np.frombuffer(r["q_v"], "<f8").reshape(-1, r["dim"])
                found = search_shard(r, np.frombuffer(r["q_ids"], "<i8"), queries, k, beam)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return best(cells(asked, index).mapInArrow(search, "query_id bigint, vec_id bigint, score double"), k)
