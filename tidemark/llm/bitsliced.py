"""Exact top-k by integer inner product over a bit-sliced index.

The index holds, for blocks of rows, one bitmap for each bit of each quantised attribute. A query's score slices are
made by adding attribute slices with bitmap arithmetic: carry-save adders over bitmaps of equal weight. The best rows
are then selected from the most significant score slice downward; rows that still tie at the boundary have the same
score, and the smallest ids among them are taken, so the result is exact.

Vectors that are null, empty or hold null or non-finite components take no part; neither do rows without id. Rows that
share an id count as one. A query meets rows with as many components as it has. Empty tables give no rows. Other
columns play no part, whatever they are called. Components are bounded by 2**31 after scaling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import best, cells, packed, usable
from tidemark.llm.common import stash

#: Rows of an index block (its bitmaps fit a core's cache) and queries of a query block.
ROWS, QUERIES = 8192, 1024


def slices(q: np.ndarray) -> dict:
    """Bitmaps of whole numbers (rows x attributes): each attribute's least value, and its excess over it bit by bit."""
    low = q.min(axis=0)
    over = (q - low).astype(np.uint64)
    depth = max(1, int(over.max()).bit_length())
    maps = [np.packbits(((over >> np.uint64(j)) & np.uint64(1)).astype(bool), axis=0, bitorder="little").T for j in range(depth)]
    words = -(-maps[0].shape[1] // 8) * 8
    whole = np.zeros((q.shape[1], depth, words), np.uint8)  # whole 64-bit words
    for j, m in enumerate(maps):
        whole[:, j, : m.shape[1]] = m
    return {"low": low.astype("<i8").tobytes(), "maps": whole.tobytes()}


def score_slices(query: np.ndarray, low: np.ndarray, maps: np.ndarray, full: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices (least significant first) of the inner products, and what is to be added to each of them.

    maps: attributes x bits x words (uint64). A negative factor works on complemented slices, so only sums remain.
    """
    depth = maps.shape[1]
    top = (1 << depth) - 1
    size = np.abs(query)
    base = int((query * low).sum()) - int(size[query < 0].sum()) * top
    levels: dict[int, list] = {}
    for i in range(int(size.max(initial=0)).bit_length()):
        for sign in (1, -1):
            mine = np.flatnonzero((size >> i & 1).astype(bool) & (np.sign(query) == sign))
            if len(mine):
                picked = maps[mine] if sign == 1 else maps[mine] ^ full
                for j in range(depth):
                    levels.setdefault(i + j, []).append(picked[:, j])
    out, level = [], 0
    while levels:
        part = levels.pop(level, None)
        if part is None:
            out.append(np.zeros_like(full))
            level += 1
            continue
        bits = np.concatenate([x.reshape(-1, len(full)) for x in part])
        while len(bits) > 1:  # three bitmaps of a weight become one of it and one of the next
            if len(bits) == 2:
                a, b = bits
                levels.setdefault(level + 1, []).append(a & b)
                bits = (a ^ b)[None]
                break
            n = len(bits) // 3
            a, b, c = bits[:n], bits[n:2 * n], bits[2 * n:3 * n]
            x = a ^ b
            levels.setdefault(level + 1, []).append((a & b) | (x & c))
            bits = np.concatenate([x ^ c, bits[3 * n:]])
        out.append(bits[0])
        level += 1
    return out, base


def select_top(levels: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the first: ``rows`` is the bitmap of those that take part."""
    sure, open_ = np.zeros_like(rows), rows.copy()
    for bits in reversed(levels):
        tried = sure | (open_ & bits)
        n = int(np.bitwise_count(tried).sum())
        if n > k:
            open_ &= bits
        else:
            sure = tried
            open_ &= ~bits
            if n == k:
                return places(sure)
    have = places(sure)
    return np.concatenate([have, places(open_)[: k - len(have)]])


def places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def values_at(levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for w, bits in enumerate(levels):
        out += ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
    return out


def search_block(query_ids, queries, ids, low, maps, k: int) -> tuple[list, list, list]:
    """The k best rows of one block for each query: lists of query ids, ids and scores."""
    full_rows = np.zeros(maps.shape[2], np.uint8)
    whole = np.packbits(np.ones(len(ids), bool), bitorder="little")
    full_rows[: len(whole)] = whole
    rows, maps = full_rows.view(np.uint64), maps.view(np.uint64)
    ones = np.full(len(rows), ~np.uint64(0))
    out: tuple[list, list, list] = ([], [], [])
    for qid, q in zip(query_ids, queries, strict=True):
        levels, base = score_slices(q, low, maps, ones)
        mine = rows
        own = np.searchsorted(ids, qid)
        if own < len(ids) and ids[own] == qid:
            mine = rows.copy()
            mine[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        at = select_top(levels, mine, k)
        out[0].append(np.full(len(at), qid))
        out[1].append(ids[at])
        out[2].append(values_at(levels, at) + base)
    return out


def index_blocks(numbers: DataFrame, rows: int = ROWS) -> DataFrame:
    """The bit-sliced index of rows (vec_id, v: whole numbers held as double), written once."""
    def pack(ids, v):
        return {"ids": ids.astype("<i8").tobytes(), **slices(v.astype(np.int64))}

    return stash(packed(numbers, rows, pack, "ids binary, low binary, maps binary"))


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest integer inner products of each row whose id ``every`` divides."""
    numbers = usable(vectors, vec_id, embedding).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    numbers = stash(numbers)
    index = index_blocks(numbers, rows)
    asked = stash(packed(numbers.where(F.pmod("vec_id", F.lit(every)) == 0), queries, lambda ids, v: {"ids": ids.astype("<i8").tobytes(), "v": v.astype("<i8").tobytes()}, "ids binary, v binary"))

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                found = search_block(np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_v"], "<i8").reshape(-1, r["dim"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["low"], "<i8"),
                                     np.frombuffer(r["maps"], np.uint8).reshape(r["dim"], -1, -(-r["size"] // 64) * 8), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in found], names=["query_id", "vec_id", "score"])

    return best(cells(asked, index).mapInArrow(search, "query_id bigint, vec_id bigint, score bigint"), k)
