"""Sharding: a minimax contiguous partition of ordered atomic groups, by binary search of the smallest feasible capacity.

Documents of equal text are one atomic group, its size the sum of theirs (UTF-8 bytes plus ``EXTRA`` each). The groups
stand in a fixed order and are cut into ``shards`` runs, so that the largest run is as small as that order allows: a
capacity is feasible if filling run after run up to it takes no more than ``shards`` runs, and the smallest feasible one
is found by bisection. The cuts follow from it.

* Order: the few heavy groups (more than 1 / ``CELLS`` of all bytes; ``CELLS`` at most) are dealt to the shards, largest
  first, each to the least filled; a shard's heavy groups stand in front of the stretch of light groups that fills it
  up. Light groups stand in the order of their text's digest. Heavy groups that fill a shard beyond the level of the
  others have it to themselves, and the search is for the others.
* The light groups are never listed as a whole. The search starts from sums over ``CELLS`` ranges of the digest; between
  the capacity at which cuts may fall anywhere inside a range and the one at which they may only fall on its ends, it
  learns which ranges a cut can fall into, and only those are split further, until the ranges in question hold one
  group each. Each round is one aggregate over the groups, of bounded result.

A null text counts as an empty one. Repeated rows each count and get slots of their own. A null id is an id like
others. Empty tables give no rows; with fewer groups than shards some shards stay empty. Other columns play no part,
whatever they are called. Slots follow the order of (digest, id) within a shard, so reruns agree. Two texts of the same
64-bit digest would be one group, which only keeps them together.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import heapify, heapreplace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash
from tidemark.llm.prefix import running_sums

#: Bytes that each document takes besides its text.
EXTRA = 8
#: First ranges of the digest (a power of 2), and parts of a range that is split.
CELLS, PARTS = 1 << 14, 1 << 6
LOW = -(1 << 63)


class Line:
    """Pieces in order, as the search knows them: ``size``, ``count`` of groups, and for light ones ``begin`` and ``bits`` (a range of the digest)."""

    def __init__(self, size, count, begin, bits, heavy):
        self.size, self.count, self.begin, self.bits, self.heavy = size, count, begin, bits, heavy
        self.ends = np.cumsum(size)
        self.total = int(self.ends[-1]) if len(size) else 0

    def reach(self, at: int, capacity: int, anywhere: bool) -> int:
        """How far a run goes that starts at ``at``. ``anywhere``: it may end inside a piece of several groups."""
        to = at + capacity
        i = int(np.searchsorted(self.ends, to, side="right"))
        if i == len(self.ends):
            return self.total
        if anywhere and self.count[i] > 1:
            return to
        return max(at, int(self.ends[i - 1]) if i else 0)

    def cuts(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, anywhere)
            out.append(at)
        return out

    def capacity(self, shards: int, anywhere: bool) -> int:
        """The smallest feasible capacity."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, anywhere)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_pieces(self, shards: int) -> np.ndarray:
        """Pieces of several groups that a cut may fall into, for any capacity that is still possible."""
        near = self.cuts(self.capacity(shards, True), shards, False)
        far = self.cuts(self.capacity(shards, False), shards, True)
        begins = self.ends - self.size
        hit = np.zeros(len(self.size), bool)
        for a, b in zip(near, far, strict=True):
            hit |= (begins <= b) & (self.ends > a)
        return np.flatnonzero(hit & (self.count > 1))


def dealt_bins(sizes: np.ndarray, shards: int) -> list[list[int]]:
    """Places of the heavy groups by shard: largest first, each to the least filled."""
    bins: list[list[int]] = [[] for _ in range(shards)]
    fill = [(0, k) for k in range(shards)]
    heapify(fill)
    for i in np.argsort(-sizes, kind="stable").tolist():
        full, k = fill[0]
        bins[k].append(i)
        heapreplace(fill, (full + int(sizes[i]), k))
    return bins


def level_of(fill: list[int], light: int) -> float:
    """The level up to which ``light`` bytes fill the shards above ``fill`` (sorted, smallest first)."""
    for k in range(len(fill), 0, -1):
        level = (light + sum(fill[:k])) / k
        if level >= fill[k - 1]:
            return level
    return 0.0


def split(groups: DataFrame, begin: np.ndarray, bits: np.ndarray, step: int):
    """Sums of light groups over the parts of some ranges, all of one width: (part's begin, size, count)."""
    width = 64 - int(bits[0])
    spark = groups.sparkSession
    asked = spark.createDataFrame([(int(b) >> width,) for b in begin], "cell bigint")  # a few hundred ranges at most
    found = groups.withColumn("cell", F.shiftright("h", width)).join(F.broadcast(asked), "cell", "left_semi")
    parts = found.groupBy(F.shiftright("h", width - step).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).toArrow()
    return [np.asarray(parts.column(c), np.int64) for c in ("part", "size", "n")]


def plan(groups: DataFrame, shards: int):
    """Where the groups (h, size) go: {h: shard} of heavy groups, and (threshold, shard): light ones from each threshold on."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    if not total:
        return {}, [(LOW, 0)]
    heavy = groups.where(F.col("size") > total / CELLS).toArrow()
    heavy_h, heavy_size = np.asarray(heavy.column("h"), np.int64), np.asarray(heavy.column("size"), np.int64)
    order = np.lexsort((heavy_h, -heavy_size))
    heavy_h, heavy_size = heavy_h[order], heavy_size[order]
    light = groups.where(F.col("size") <= total / CELLS)
    width = 64 - (CELLS.bit_length() - 1)
    cells = light.groupBy(F.shiftright("h", width).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("cell").toArrow()
    cell, size, count = (np.asarray(cells.column(c), np.int64) for c in ("cell", "size", "n"))

    bins = dealt_bins(heavy_size, shards)
    fill = sorted((int(heavy_size[b].sum()) if b else 0, k) for k, b in enumerate(bins))
    level = level_of([f for f, _ in fill], int(size.sum()))
    own = [k for f, k in fill if f > level]
    place = {int(heavy_h[i]): s for s, k in enumerate(own) for i in bins[k]}
    rest, first = [k for f, k in fill if f <= level], len(own)
    if not rest:  # no light group is left and all shards are level
        return place, [(LOW, 0)]

    # the line: each shard's heavy groups, then light ranges until the shard is level
    pieces, at = [], 0
    ends = np.cumsum(size)
    for j, k in enumerate(rest):
        pieces += [(int(heavy_size[i]), 1, int(heavy_h[i]), 0, True) for i in bins[k]]
        wanted = sum(level - f for f, m in fill if m in rest[:j + 1])
        stop = len(cell) if j == len(rest) - 1 else max(at, bisect_right(ends.tolist(), wanted))
        pieces += [(int(size[i]), int(count[i]), int(cell[i]) << width, 64 - width, False) for i in range(at, stop)]
        at = stop
    if not pieces:
        return place, [(LOW, 0)]
    line = Line(*[np.array(x, t) for x, t in zip(zip(*pieces, strict=True), (np.int64, np.int64, np.int64, np.int64, bool), strict=True)])

    shards = len(rest)
    while len(asked := line.open_pieces(shards)):
        bits = int(line.bits[asked].min())
        asked = asked[line.bits[asked] == bits]
        step = min(PARTS.bit_length() - 1, 64 - bits)
        part, size, count = split(light, line.begin[asked], line.bits[asked], step)
        begin = part << (64 - bits - step)
        order = np.argsort(begin, kind="stable")
        begin, size, count = begin[order], size[order], count[order]
        owner = np.searchsorted(np.sort(line.begin[asked]), begin, side="right") - 1
        owner = asked[np.argsort(line.begin[asked], kind="stable")][owner]
        gone = np.setdiff1d(np.arange(len(line.size)), asked)
        where = np.concatenate([gone, owner])
        order = np.argsort(where, kind="stable")
        fresh = ((line.size, size), (line.count, count), (line.begin, begin), (line.bits, np.full(len(begin), bits + step)), (line.heavy, np.zeros(len(begin), bool)))
        line = Line(*[np.concatenate([old[gone], new])[order] for old, new in fresh])

    cuts = line.cuts(line.capacity(shards, False), shards, False)
    shard = first + np.searchsorted(np.array(cuts[:-1], np.int64), line.ends - line.size, side="right")
    place |= {int(h): int(s) for h, s in zip(line.begin[line.heavy], shard[line.heavy], strict=True)}
    own_begin, own_shard = line.begin[~line.heavy], shard[~line.heavy]
    by_digest = np.argsort(own_begin, kind="stable")
    own_begin, own_shard = own_begin[by_digest], own_shard[by_digest]
    turns = [0, *(np.flatnonzero(np.diff(own_shard)) + 1).tolist()] if len(own_shard) else []
    return place, [(LOW, int(own_shard[0]) if len(own_shard) else 0), *[(int(own_begin[t]), int(own_shard[t])) for t in turns[1:]]]


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (its place in the shard, from 0) of every document."""
    spark = docs.sparkSession
    held = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(held) + EXTRA).cast("long").alias("size"), F.crc32(held.cast("binary")).alias("text_crc32"), F.xxhash64(held).alias("h"))
    rows = stash(rows.withColumn("part", F.spark_partition_id()))
    groups = stash(rows.groupBy("h").agg(F.sum("size").alias("size")))
    place, turns = plan(groups, shards)
    shard = F.lit(turns[0][1])
    for threshold, s in turns[1:]:  # as many as there are shards at most
        shard = F.when(F.col("h") >= threshold, s).otherwise(shard)
    heavy = spark.createDataFrame(list(place.items()), "h bigint, own int")  # CELLS rows at most
    dealt = rows.join(F.broadcast(heavy), "h", "left").withColumn("shard", F.coalesce("own", shard).cast("int")).withColumn("one", F.lit(1)).drop("own")
    # rows alike in digest and id stand in order of the input part that held them: a flood of them spreads over the ranges
    found = running_sums(dealt, ["shard"], ["h", "doc_id", "part"], {"slot": "one"})
    return found.select(F.col("doc_id").alias(doc_id), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
