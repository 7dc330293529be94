"""N-gram Jaccard join: signature trees over documents that share a rare shingle, and the components of the links.

1. Documents that can link share a shingle among the rarest of each (rarest by a counting sketch over all documents,
   of fixed size; any order is lossless). Such a shingle is the key of a group. Equal sets link at once. The first
   shingle that two documents share in that order has at most as many common ones behind it as either has left, so its
   place bounds the partner's size; who finds no such partner in a group leaves it.
2. Within a group everyone is first held against its smallest member, so a group of copies costs as many checks as it
   has members, never their square. Pairs whose sizes or token bitmaps leave no room for a link are dropped; the others
   are confirmed on the exact sets of shingles.
3. Members of a group that still lie in different components meet in signature trees: nodes hold the OR of their
   documents' token bitmaps, their range of sizes and components, and a dual traversal drops pairs of nodes whose
   largest possible overlap is too small, or which are one component. A first traversal finds the few documents that
   have a candidate at all; a second one, over these and with the other keys of each, gives every pair once, in the
   group of the smallest key that both have. Pairs that pass finer counts of their shingles are confirmed on the exact
   sets. Groups of the same members are one group; a large group is cut by size into blocks, and blocks whose sizes
   lie too far apart never meet.

A null text, or one without words, has no shingles and links with nothing; a text with fewer words than a shingle is
one shingle. Rows that share an id are one document, linked by any of their texts. Rows without id take no part; their
component is null. Empty tables give no rows. Other columns play no part in ``components`` and pass through
``one_of_each`` whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASES, BROADCAST_IDS, Words, dealt, grouped, mix, only_ids, pieces, ranges, small_batches, stash, tasks, window_sums

#: Counters of the sketch, in how many slices they travel, bits of a token bitmap, children of a tree's node.
COUNTERS, SLICES, BITS, FAN = 1 << 20, 16, 2048, 8
#: Documents of a block in a large group, bytes of text handled at once, and bytes of text whose keys one bucket gets.
BLOCK, BATCH_BYTES, BUCKET_BYTES = 1024, 4 << 20, 256 << 20
#: Buckets at least; partners of a document that are checked together.
BUCKETS, PARTNERS = 64, 256
ROWS = "bucket int, kind int, doc binary, size binary, keys binary, n binary, reach binary"
PAIRS = "kind int, key bigint, a bigint, b bigint"


def text_slices(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield from pieces(pa.Table.from_batches([batch]), "text", BATCH_BYTES)


def shingles(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each shingle (with repeats); a text of fewer than k words has one."""
    words = Words(texts, lower=True)
    runs, first = words.windows(k)
    n = np.diff(words.first)
    few = np.flatnonzero((n > 0) & (n < k))
    whole = mix(window_sums(words.hashes[0], words.first[few], words.first[few + 1], BASES[0][1]) + n[few].astype(np.uint64))
    return np.concatenate([np.repeat(np.arange(len(n)), np.diff(first)), few]), np.concatenate([runs, whole])


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)  # 20 bits


def distinct_sets(owner, hashes, counts=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash), by owner, then count, then hash."""
    order = np.lexsort((hashes, owner) if counts is None else (hashes, counts[counter_of(hashes)], owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def sizes_and_sketch(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc, n) for every document and rows (slice, counts) for every task."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(COUNTERS, np.uint32)
        for part in text_slices(batches):
            owner, hashes = distinct_sets(*shingles(part.column("text").combine_chunks(), k))
            at, n = np.unique(counter_of(hashes), return_counts=True)
            total[at] += n.astype(np.uint32)
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("doc").combine_chunks(), pa.array(np.bincount(owner, minlength=rows)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["doc", "n", "slice", "counts"])
        if total.any():
            width = COUNTERS // SLICES
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([total[i * width:(i + 1) * width].tobytes() for i in range(SLICES)], pa.binary())], names=["doc", "n", "slice", "counts"])

    return docs.mapInArrow(count, "doc bigint, n bigint, slice int, counts binary")


def summed_sketch(rows: DataFrame) -> np.ndarray:
    """The tasks' counters summed up slice by slice; COUNTERS numbers, however large the input."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for number, own in grouped(batches, "slice"):
            total = np.zeros(COUNTERS // SLICES, np.uint64)
            for r in own:
                total += np.frombuffer(r["counts"], np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()])], names=["slice", "counts"])

    out = np.zeros(COUNTERS, np.uint32)
    width = COUNTERS // SLICES
    for r in rows.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, counts binary").collect():
        out[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r.counts, np.uint32)
    return out


def keyed(docs: DataFrame, k: int, threshold: int, sketch, buckets: int) -> DataFrame:
    """Packed rows by bucket. Kinds: 0 the rare shingles of documents, with the size of each set and how large a partner
    may be at most that shares this shingle as its first; 1 digests of whole sets; 3 pairs of equal sets within the batch
    (doc: first, second, first, ...).
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = sketch.value
        for part in text_slices(batches):
            ids = part.column("doc").to_numpy()
            owner, hashes = distinct_sets(*shingles(part.column("text").combine_chunks(), k), counts)
            n = np.bincount(owner, minlength=len(ids))
            first = np.cumsum(n) - n
            have = np.flatnonzero(n)
            if not len(have):
                continue
            digest = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first[have]) + n[have].astype(np.uint64))
            found = []
            lead = settle(found, digest, ids[have], have, buckets)
            # the others have their leader's set
            size = n[lead] - -(-threshold * n[lead] // 100) + 1
            at, owner = ranges(first[lead], size), np.repeat(lead, size)
            reach = (100 * n[owner] - (100 + threshold) * (at - first[owner])) // threshold
            for b, who, count, keys, far in dealt((hashes[at] % np.uint64(buckets)).astype(np.uint32), owner, hashes[at], reach):
                found.append((b, 0, *[x.astype(t).tobytes() for x, t in ((ids[who], "<i8"), (count, "<u4"), (keys, "<u8"), (n[who], "<u4"), (far, "<u4"))]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32() if i < 2 else pa.binary()) for i in range(7)], names=["bucket", "kind", "doc", "size", "keys", "n", "reach"])

    return docs.mapInArrow(cut, ROWS)


def settle(found: list, keys: np.ndarray, docs: np.ndarray, place: np.ndarray, buckets: int) -> np.ndarray:
    """Of the documents of a batch that have one digest the smallest goes on; pairs with it are kept. Returns who goes on."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    rest = np.flatnonzero(~lead & (docs != docs[head]))
    if len(rest):
        pair = np.stack([docs[head[rest]], docs[rest]], axis=1).ravel()
        found.append((int(docs[head[rest[0]]] % buckets), 3, pair.astype("<i8").tobytes(), b"", keys[rest].tobytes(), b"", b""))
    k, d = keys[lead], docs[lead]
    by_doc = np.argsort(d, kind="stable")
    found += [(b, 1, o.astype("<i8").tobytes(), s.astype("<u4").tobytes(), x.tobytes(), b"", b"") for b, o, s, x in dealt((k[by_doc] % np.uint64(buckets)).astype(np.uint32), d[by_doc], k[by_doc])]
    return place[order[lead]]


def range_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest of values[low:high] for each range; -1 for an empty one."""
    out = np.full(len(low), -1, np.int64)
    length = high - low
    level = np.where(length > 0, np.frexp(np.maximum(length, 1))[1] - 1, -1)
    for i in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == i)
        out[own] = np.maximum(values[low[own]], values[high[own] - (1 << i)])
        values = np.maximum(values[:-(1 << i)], values[1 << i:])  # of twice as many from here on
    return out


def in_reach(keys: np.ndarray, n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether each row has another of its key such that neither's n is above the other's reach."""
    order = np.lexsort((n, keys))
    keys, n, reach = keys[order], n[order], reach[order]
    group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]).astype(np.int64) << 32
    first, here = np.searchsorted(group, group), np.arange(len(keys))
    end = np.searchsorted(group + n, group + reach, side="right")
    out = np.zeros(len(keys), bool)
    out[order] = np.maximum(range_max(reach, first, np.minimum(here, end)), range_max(reach, here + 1, end)) >= n
    return out


def candidate_pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """kind (0: to be confirmed, 1: equal sets), key, a and b: each document of a group beside the group's smallest."""

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def send(kind, keys, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(a), pa.array(b)], names=["kind", "key", "a", "b"])

        for _, own in grouped(batches, "bucket"):
            held: dict[int, list] = {0: [], 1: []}
            for r in own:
                docs, keys = np.frombuffer(r["doc"], "<i8"), np.frombuffer(r["keys"], "<u8")
                if r["kind"] >= 2:
                    yield send(r["kind"] - 2, keys, docs[::2], docs[1::2])
                else:
                    count = np.frombuffer(r["size"], "<u4").astype(np.int64)
                    more = (np.repeat(np.frombuffer(r["n"], "<u4"), count), np.frombuffer(r["reach"], "<u4")) if r["kind"] == 0 else ()
                    held[r["kind"]].append((keys, np.repeat(docs, count), *more))
            for kind, parts in held.items():
                if not parts:
                    continue
                keys, docs, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
                if more:
                    near = in_reach(keys, *[x.astype(np.int64) for x in more])
                    keys, docs = keys[near], docs[near]
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                lead = np.ones(len(keys), bool)
                lead[1:] = keys[1:] != keys[:-1]
                head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
                rest = np.flatnonzero(~lead & (docs != docs[head]))
                if len(rest):
                    yield send(kind, keys[rest], docs[head[rest]], docs[rest])

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(match, PAIRS)


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b; distinct, stashed) whose sets reach the threshold: 100 * intersection >= threshold * union.

    The partners of one document are dealt to parts of about PARTNERS, each of which gets the document's text.
    """

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centre, sets = None, []
        for part in text_slices(batches):
            owner, hashes = distinct_sets(*shingles(part.column("text").combine_chunks(), k))
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            good: tuple[list, list] = ([], [])
            for i, (a, share, doc) in enumerate(zip(*[part.column(c).to_pylist() for c in ("a", "share", "doc")], strict=True)):
                mine = hashes[ends[i]:ends[i + 1]]
                if (a, share) != centre:
                    centre, sets = (a, share), []
                if doc == a:
                    sets.append(mine)
                    continue
                for other in sets:
                    if 100 * min(len(mine), len(other)) < threshold * max(len(mine), len(other)) or not len(mine):
                        continue
                    both = np.concatenate([mine, other])
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= threshold * (len(both) - same):
                        good[0].append(a)
                        good[1].append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in good], names=["a", "b"])

    ids = stash(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct())
    texts = only_ids(docs, "doc", ids)
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    dealt_out = pairs.join(shares, "a").select("a", F.col("b").alias("doc"), F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    members = texts.join(dealt_out, "doc").select("a", "share", "doc", "text")
    centres = texts.join(shares.withColumnRenamed("a", "doc"), "doc").select(F.col("doc").alias("a"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "doc", "text")
    rows = members.unionByName(centres).repartition(tasks(docs.sparkSession), "a", "share").sortWithinPartitions("a", "share", F.col("doc") != F.col("a"))
    return rows.mapInArrow(check, "a bigint, b bigint").distinct()


def connected(links: DataFrame) -> DataFrame:
    """doc and component (the smallest document reachable) of every document in a link (a < b), by stars made larger and smaller in turn."""
    def least(edges):
        return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def mark(edges):
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    # each step deals the edges by u once; sums, join and the next step's stars all keep that dealing
    edges = stash(links.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u <> v").distinct())
    before, now = None, mark(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        large = both.join(least(both), "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        low = least(large)
        edges = stash(large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct())
        before, now = now, mark(edges)
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc, n (size of its set) and bits (its token bitmap). Rows that share an id each have one."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in text_slices(batches):
            owner, hashes = distinct_sets(*shingles(part.column("text").combine_chunks(), k))
            bits = np.zeros((part.num_rows, BITS // 8), np.uint8)
            at = (hashes % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(bits, (owner, at >> 3), (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([part.column("doc").combine_chunks(), pa.array(np.bincount(owner, minlength=part.num_rows)), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc", "n", "bits"])

    return docs.mapInArrow(sign, "doc bigint, n bigint, bits binary")


def plausible(pairs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes and token bitmaps leave room for the threshold; the others cannot link."""

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [batch.column(f"n_{s}").to_numpy() for s in "ab"]
            bits = [np.frombuffer(b"".join(batch.column(f"bits_{s}").to_pylist()), np.uint64).reshape(-1, BITS // 64) for s in "ab"]
            surplus = [size - np.bitwise_count(b).sum(axis=1).astype(np.int64) for size, b in zip(n, bits, strict=True)]
            overlap = np.minimum(np.bitwise_count(bits[0] & bits[1]).sum(axis=1).astype(np.int64) + np.minimum(*surplus), np.minimum(*n))
            keep = pa.array((100 + threshold) * overlap >= threshold * (n[0] + n[1]))
            yield pa.RecordBatch.from_arrays([batch.column(s).filter(keep) for s in "ab"], names=["a", "b"])

    size = lambda s: signed.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"))
    near = F.col("n_a") * 100 >= threshold * F.col("n_b")
    sized = pairs.join(size("a"), "a").join(size("b"), "b").where(near & (F.col("n_b") * 100 >= threshold * F.col("n_a")))
    side = lambda s: signed.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    return sized.join(side("a"), ["a", "n_a"]).join(side("b"), ["b", "n_b"]).mapInArrow(match, "a bigint, b bigint").distinct()


def counters(docs: DataFrame, k: int) -> DataFrame:
    """doc, n and counts: how many of its shingles fall into each of about n buckets (4 bits each; what exceeds them is left out)."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in text_slices(batches):
            owner, hashes = distinct_sets(*shingles(part.column("text").combine_chunks(), k))
            n = np.bincount(owner, minlength=part.num_rows)
            ends, packed = np.concatenate([[0], np.cumsum(n)]), []
            for i in range(part.num_rows):
                width = max(8, 1 << int(max(n[i] - 1, 1)).bit_length())
                c = np.minimum(np.bincount((hashes[ends[i]:ends[i + 1]] >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width), 15).astype(np.uint8)
                packed.append((c[::2] | (c[1::2] << 4)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc").combine_chunks(), pa.array(n), pa.array(packed, pa.binary())], names=["doc", "n", "counts"])

    return docs.mapInArrow(count, "doc bigint, n bigint, counts binary")


def unpacked(counts: bytes, width: int) -> np.ndarray:
    """Counts folded to ``width`` buckets."""
    raw = np.frombuffer(counts, np.uint8)
    c = np.empty(2 * len(raw), np.int64)
    c[::2], c[1::2] = raw & 15, raw >> 4
    return c.reshape(-1, width).sum(axis=0)


def closer(pairs: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b; distinct, stashed) whose counts leave room for the threshold: a bucket holds at most as many common shingles as either side has."""

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for n, m, x, y in zip(*[batch.column(c).to_pylist() for c in ("n_a", "n_b", "c_a", "c_b")], strict=True):
                width = 2 * min(len(x), len(y))
                x, y = unpacked(x, width), unpacked(y, width)
                overlap = min(int(np.minimum(x, y).sum()) + min(n - int(x.sum()), m - int(y.sum())), n, m)
                keep.append((100 + threshold) * overlap >= threshold * (n + m))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(s).filter(keep) for s in "ab"], names=["a", "b"])

    ids = stash(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct())
    counted = stash(counters(only_ids(docs, "doc", ids), k))
    side = lambda s: counted.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("counts").alias(f"c_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(match, "a bigint, b bigint").distinct()


class Tree:
    """Levels of nodes, documents first: OR of bitmaps, least and largest size, surplus of tokens over bits, range of components."""

    def __init__(self, n, bits, component):
        single = np.bincount(np.unique(component, return_inverse=True)[1])[np.unique(component, return_inverse=True)[1]] == 1
        self.order = np.lexsort((n, np.where(single, 0, component), single))  # whole components side by side, others by size
        n, bits, component = n[self.order], bits[self.order], component[self.order]
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(axis=1).astype(np.int64), component, component)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, surplus, c0, c1 = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(surplus, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))


def possible(x: Tree, y: Tree, level: int, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Whether nodes i of x and j of y can hold a pair of different components that reaches the threshold."""
    (xb, xl, xh, xs, x0, x1), (yb, yl, yh, ys, y0, y1) = x.levels[level], y.levels[level]
    keep = ~((x0[i] == x1[i]) & (y0[j] == y1[j]) & (x0[i] == y0[j])) & (100 * xh[i] >= threshold * yl[j]) & (100 * yh[j] >= threshold * xl[i])
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(keep)
    for s in range(0, len(at), 1 << 15):
        a, b = i[at[s:s + (1 << 15)]], j[at[s:s + (1 << 15)]]
        overlap = np.bitwise_count(xb[a] & yb[b]).sum(axis=1).astype(np.int64) + np.minimum(xs[a], ys[b])
        overlap = np.minimum(overlap, np.minimum(xh[a], yh[b]))
        out[at[s:s + (1 << 15)]] = (100 + threshold) * overlap >= threshold * (xl[a] + yl[b])
    return out


def dual_traversal(x: Tree, y: Tree, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the documents of x and y that may link. For a tree with itself each pair comes once."""
    level = max(len(x.levels), len(y.levels)) - 1
    for t in (x, y):
        while len(t.levels) <= level:
            t.levels.append(t.levels[-1])  # one root stays one root
    i = j = np.zeros(1, np.int64)
    while True:
        if x is y:
            i, j = i[i <= j], j[i <= j]
        keep = possible(x, y, level, i, j, threshold)
        i, j = i[keep], j[keep]
        if level == 0:
            break
        level -= 1
        nx, ny = (len(t.levels[level][1]) for t in (x, y))
        fx, fy = (1 if len(t.levels[level + 1][1]) == n else FAN for t, n in ((x, nx), (y, ny)))
        steps = np.arange(fx * fy)
        i, j = (i[:, None] * fx + steps[None, :] // fy).ravel(), (j[:, None] * fy + steps[None, :] % fy).ravel()
        inside = (i < nx) & (j < ny)
        i, j = i[inside], j[inside]
    if x is y:
        i, j = i[i < j], j[i < j]
    return x.order[i], y.order[j]


def cells(members: DataFrame, threshold: int) -> DataFrame:
    """Members (key, doc, n, ...) with ``cell`` and ``block``: the blocks of a group, two at a time.

    A group of more than BLOCK members is cut into bands of sizes and these, where large, into parts by id. Documents
    that can link lie in one band or in two neighbours, so other blocks never meet.
    """
    band = F.floor(F.log("n") / (log(100 / threshold) * (1 + 1e-9))).cast("long")
    sized = members.withColumn("band", band)
    runs = sized.groupBy("key", "band").agg(F.count("*").alias("rows"))
    runs = runs.join(runs.groupBy("key").agg(F.sum("rows").alias("whole")), "key")
    small = F.col("whole") <= BLOCK
    parts = stash(runs.groupBy("key", F.when(small, 0).otherwise(F.col("band")).alias("band"), small.alias("small")).agg(F.ceil(F.sum("rows") / BLOCK).cast("long").alias("parts")))
    beside = lambda name, step: parts.where("NOT small").select("key", (F.col("band") + step).alias("band"), F.col("parts").alias(name))
    parts = parts.join(beside("lower", 1), ["key", "band"], "left").join(beside("upper", -1), ["key", "band"], "left")
    one = sized.join(parts.where("small").select("key", "parts"), "key", "left")
    large = one.where("parts IS NULL").drop("parts").join(parts.where("NOT small").drop("small"), ["key", "band"])
    first = F.col("band") * (1 << 20)
    blocks = lambda n, start: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: start + i)).otherwise(F.array().cast("array<bigint>"))
    large = large.withColumn("block", first + F.pmod(F.xxhash64("doc"), F.col("parts")))
    large = large.withColumn("other", F.explode(F.concat(blocks("parts", first), blocks("lower", first - (1 << 20)), blocks("upper", first + (1 << 20)))))
    large = large.withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    one = one.where("parts IS NOT NULL").withColumn("block", F.lit(0).cast("long")).withColumn("cell", F.xxhash64("key"))
    return one.select("cell", "block", *members.columns).unionByName(large.select("cell", "block", *members.columns))


def met(members: DataFrame, signed: DataFrame, threshold: int, pairs: bool) -> DataFrame:
    """Documents of one group, in different components, that may link.

    members: key, doc, component, n. Without ``pairs``: key and doc of those with any candidate. With ``pairs``: a and b
    (a < b), each in the group of the smallest key that both have (``keys``, sorted).
    """
    rows = cells(members, threshold).join(signed.select("doc", "n", "bits"), ["doc", "n"])

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, found in grouped(batches, "cell"):
            held: dict[int, list] = {}
            for r in found:
                held.setdefault(r["block"], []).append(r)
            sides = [([r["doc"] for r in own], [r["component"] for r in own], [r["n"] for r in own], own) for own in held.values()]
            docs, parts = ([np.array(s[i], np.int64) for s in sides] for i in (0, 1))
            trees = [Tree(np.array(s[2], np.int64), np.frombuffer(b"".join(r["bits"] for r in s[3]), np.uint64).reshape(len(s[3]), -1), c) for s, c in zip(sides, parts, strict=True)]
            x, y = 0, len(trees) - 1
            i, j = dual_traversal(trees[x], trees[y], threshold)
            a, b = docs[x][i], docs[y][j]
            apart = (parts[x][i] != parts[y][j]) & (a != b)
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(a):
                continue
            key = sides[0][3][0]["key"]
            if not pairs:
                out = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), key)), pa.array(out)], names=["key", "doc"])
                continue
            first = first_shared([r["keys"] for r in sides[x][3]], [r["keys"] for r in sides[y][3]], i, j, key)
            a, b = a[first], b[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt_out = rows.repartition(tasks(members.sparkSession), "cell").sortWithinPartitions("cell", "block")
    return dealt_out.mapInArrow(match, "a bigint, b bigint" if pairs else "key bigint, doc bigint").distinct()


def first_shared(left: list, right: list, i: np.ndarray, j: np.ndarray, key: int) -> np.ndarray:
    """Whether left[i] and right[j] (sorted keys) have none below ``key`` in common."""
    low = [np.array([k for k in x if k < key], np.int64) for x in left]
    other = low if right is left else [np.array([k for k in x if k < key], np.int64) for x in right]
    return np.array([not len(np.intersect1d(low[p], other[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)


def components(docs: DataFrame, words: int = 3, threshold: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document: sets of ``words``-word shingles link at a Jaccard similarity of ``threshold`` percent."""
    spark = small_batches(docs).sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    first = stash(sizes_and_sketch(base, words))
    base = base.where("doc IS NOT NULL")
    sketch = spark.sparkContext.broadcast(summed_sketch(first))  # COUNTERS numbers
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, ceil(size / BUCKET_BYTES))
    found = stash(candidate_pairs(keyed(base, words, threshold, sketch, buckets), buckets))
    equal = found.where("kind = 1").select("a", "b")
    groups = found.where("kind = 0").select("key", "a", "b")
    ids = stash(groups.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    signed = stash(signatures(only_ids(base, "doc", ids), words))
    tried = stash(groups.select("a", "b").distinct())
    likely = stash(plausible(tried.join(equal, ["a", "b"], "left_anti"), signed, threshold))
    links = stash(confirmed(likely, base, words, threshold).unionByName(equal))
    whole = stash(connected(links))
    # groups of three or more that hold more than one component have pairs that nobody has looked at
    named = lambda side: whole.select(F.col("doc").alias(side), F.col("component").alias(f"c_{side}"))
    split = stash(tried.join(named("a"), "a", "left").join(named("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"))
    apart = groups.join(split, ["a", "b"], "left_semi").select("key").distinct()
    large = groups.join(stash(apart), "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("doc")).distinct()
    large = stash(large)
    # groups of three or more, and of those with the same members one
    several = large.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who")).where("rows > 2").groupBy("rows", "who").agg(F.min("key").alias("key")).select("key")
    members = large.join(several, "key", "left_semi").join(whole, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    members = stash(members.join(signed.select("doc", "n"), "doc"))
    near = stash(met(members, signed, threshold, pairs=False))
    lists = near.groupBy("doc").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # rare keys of one document
    few = stash(members.join(near, ["key", "doc"], "left_semi").join(lists, "doc"))
    more = stash(met(few, signed, threshold, pairs=True).join(tried, ["a", "b"], "left_anti"))
    more = stash(closer(more, base, words, threshold)) if not more.isEmpty() else more
    new = stash(confirmed(more, base, words, threshold)) if not more.isEmpty() else more
    if not new.isEmpty():  # the components that the new links join, by their smallest documents
        merged = new.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y")).where("x <> y")
        joined = connected(merged.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).select(F.col("doc").alias("component"), F.col("component").alias("now"))
        every = whole.unionByName(new.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(whole, "doc", "left_anti").select("doc", F.col("doc").alias("component")))
        whole = stash(every.join(joined, "component", "left").select("doc", F.coalesce("now", "component").alias("component")))
    rows = first.where("slice IS NULL").select("doc", "n")
    return rows.join(whole, "doc", "left").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, of each component only the one with the smallest id; those without id stay."""
    found = components(docs, words, threshold, doc_id, text)
    out = stash(found.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias("gone_")).distinct())
    small = out.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(out) if small else out, F.col(doc_id) == F.col("gone_"), "left_anti")
