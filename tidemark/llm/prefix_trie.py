"""Conversation prefix trie: vertical bitmaps, (position, turn) to sets of conversations, met depth first.

1. Turns get their place in their conversation by running sums over ranges, so a conversation of any length spans many
   tasks. A conversation is rebuilt: it takes the first turns of the block's first conversation, then its own later ones.
2. Turns are digests of (role, text) and counts of words from here on. A shard holds ``SPAN`` neighbouring ids and
   ``DEPTH`` positions, a layer; where a conversation goes on in another layer, that layer begins with the hash of all
   that came before. In a shard each (position, turn) has a bitset of conversations; from a node's bitset, its meets
   with the postings of the next position are its children, their popcounts the numbers of members, and what is left
   are the conversations that end. A conversation that is alone needs no more meets: its rest is one path.
3. Nodes of all shards are added up by the hash of their sequence. Sums over subtrees: every node is counted in the
   shard that holds its smallest member, along the order of the traversal; what lies in deeper layers is handed up by
   the conversations that own it.

A null role or text counts as empty. Rows without conversation id take no part. Rows of one turn number stand in the
order of their digests, a null turn number first; repeated rows are turns of their own. A conversation whose rebuilt
form has no turn ends in the root. Empty tables give no rows. Other columns play no part, whatever they are called.
``c % block`` has the sign of c. Turns and sequences are compared by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import BASES, mix, n_words, powers, stash, tasks
from tidemark.llm.prefix import running_sums

#: Ids of a shard, and positions of a layer.
SPAN, DEPTH = 1000, 1024
NODES = "kind int, shard bigint, layer bigint, seq bigint, stop bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, n bigint, low bigint, words bigint, ends binary"
KEY = ["k1", "k2"]


def numbered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, lo and hi (digest of the turn), words and i (the turn's place from 0)."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(r, F.lit(0), t).alias("lo"), F.xxhash64(F.lit(1), t, F.lit(2), r).alias("hi"), n_words(t).alias("words"), F.lit(1).alias("one"))
    return running_sums(rows.where("conv IS NOT NULL"), ["conv"], ["turn", "lo", "hi"], {"i": "one"}).select("conv", "lo", "hi", "words", "i")


def rebuilt(rows: DataFrame, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, lo, hi, words) of the rebuilt turns, and (conv, taken, kept, size) of every conversation."""
    own = rows.groupBy("conv").agg(F.count("*").alias("rows")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most).withColumn("base", F.col("conv") - F.col("conv") % block)
    heads = rows.where((F.col("i") < most - 1) & (F.col("conv") % block == 0)).select(F.col("conv").alias("base"), "lo", "hi", "words", "i")
    lent = stash(own.select("conv", "h", "base").join(heads, "base").where("i < h").select("conv", F.col("i").alias("pos"), "lo", "hi", "words"))
    taken = lent.groupBy("conv").agg(F.count("*").alias("taken"))
    convs = stash(own.join(taken, "conv", "left").select("conv", "h", F.coalesce("taken", F.lit(0)).alias("taken"), (F.coalesce("taken", F.lit(0)) + F.greatest(F.col("rows") - F.col("h"), F.lit(0))).alias("size")))
    later = rows.join(convs.select("conv", "h", "taken"), "conv").where("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("taken")).alias("pos"), "lo", "hi", "words")
    return lent.unionByName(later), convs


def lanes(lo, hi, pos, layer: int) -> list[np.ndarray]:
    """Each turn's part of the two sequence hashes: digest times a power of the base, so that parts add up (mod 2**64)."""
    pos = np.asarray(pos, np.int64)
    out = []
    for digest, (_, base) in zip((lo, hi), BASES, strict=True):
        jump = {int(x): np.uint64(pow(base, int(x) * layer, 1 << 64)) for x in np.unique(pos // layer)}
        far = np.array([jump[x] for x in (pos // layer).tolist()], np.uint64)
        out.append(np.asarray(digest).view(np.uint64) * far * powers(base, layer)[pos % layer])
    return out


def starts(turns: DataFrame, convs: DataFrame, layer: int) -> DataFrame:
    """conv, layer and the upper and lower halves of the two sequence hashes of all earlier layers (a, b and c, d), for layers after the first."""
    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pos = b.column("pos").to_numpy()
            sums = lanes(b.column("lo").to_numpy(), b.column("hi").to_numpy(), pos, layer)
            halves = [x for s in sums for x in (s >> np.uint64(32), s & np.uint64(0xFFFFFFFF))]
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(pos // layer), *[pa.array(x.astype(np.int64)) for x in halves]], names=["conv", "layer", "a", "b", "c", "d"])

    long = turns.join(convs.where(F.col("size") > layer).select("conv"), "conv", "left_semi")
    sums = long.mapInArrow(part, "conv bigint, layer bigint, a bigint, b bigint, c bigint, d bigint").groupBy("conv", "layer").agg(*[F.sum(x).alias(x) for x in "abcd"])
    before = W.partitionBy("conv").orderBy("layer").rowsBetween(W.unboundedPreceding, -1)  # one row for each layer of a conversation
    return sums.select("conv", "layer", *[F.sum(x).over(before).alias(x) for x in "abcd"]).where("layer > 0")


class Shard:
    """The trie of a shard's layer (the ``number``-th, of ``layer`` positions). ``table``: conv, pos (-1: the conversation itself), lo, hi, words, size, and what ``starts`` gives."""

    def __init__(self, table, number: int, layer: int):
        col = {c: table.column(c).to_numpy() for c in ("conv", "pos", "lo", "hi", "words", "size", *"abcd")}
        order = np.lexsort((col["pos"], col["conv"]))
        col = {c: v[order] for c, v in col.items()}
        turn = np.flatnonzero(col["pos"] >= 0)
        self.convs, head = np.unique(col["conv"], return_index=True)
        self.size = col["size"][head]
        self.base = number * layer
        start = [(col[x][head].astype(np.uint64) << np.uint64(32)) + col[y][head].astype(np.uint64) for x, y in ("ab", "cd")]
        self.row = {c: col[c][turn] for c in ("pos", "words")}
        own = np.searchsorted(self.convs, col["conv"][turn])
        self.owner = own
        self.first = np.searchsorted(own, np.arange(len(self.convs) + 1))
        parts = lanes(col["lo"][turn], col["hi"][turn], self.row["pos"], layer) if len(turn) else [np.zeros(0, np.uint64)] * 2
        self.keys, self.parents = [], []
        for part, s in zip(parts, start, strict=True):
            total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
            here = total[1:] - total[self.first[own]] + s[own]
            depth = self.row["pos"].astype(np.uint64)
            self.keys.append(mix(here + depth + np.uint64(1)))
            self.parents.append(mix(here - part + depth))
        self.start = start
        # vertical bitmaps of the postings
        place = self.row["pos"] - self.base
        self.posting = np.unique(np.stack([place.view(np.uint64), col["lo"][turn].view(np.uint64), col["hi"][turn].view(np.uint64)], axis=1), axis=0, return_inverse=True)[1].ravel() if len(turn) else np.zeros(0, np.int64)
        self.width = len(self.convs) // 64 + 1
        many = np.bincount(self.posting, minlength=1)
        self.bitmap = np.full(len(many), -1)
        self.bitmap[many > 1] = np.arange((many > 1).sum())
        self.bits = np.zeros((int((many > 1).sum()), self.width), np.uint64)
        shared = np.flatnonzero(many[self.posting] > 1) if len(turn) else np.zeros(0, np.int64)
        np.bitwise_or.at(self.bits, (self.bitmap[self.posting[shared]], own[shared] >> 6), np.uint64(1) << (own[shared] & 63).astype(np.uint64))

    def members(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))

    def as_bits(self, members: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(out, members >> 6, np.uint64(1) << (members & 63).astype(np.uint64))
        return out

    def nodes(self):
        """Nodes in depth-first order: their first member's row (-1: the root), number of members, and who ends there."""
        rows, counts, ends, n_out = [], [], {}, 0
        groups = np.unique(np.stack(self.start, axis=1), axis=0, return_inverse=True)[1].ravel()
        stack = []
        if self.base == 0:
            rows.append(np.array([-1]))
            counts.append(np.array([len(self.convs)]))
            done = np.flatnonzero(self.size == 0)
            if len(done):
                ends[0] = done
            n_out = 1
            stack = [(self.as_bits(np.arange(len(self.convs))), 0)]
        else:
            for g in range(groups.max(initial=-1), -1, -1):
                stack.append((self.as_bits(np.flatnonzero(groups == g)), 0))
        held = np.diff(self.first)
        while stack:
            bits, at = stack.pop()
            if at:  # a node of this layer: ``at`` turns deep
                who = self.members(bits)
                lead = who[0]
                if len(who) == 1:  # alone: the rest is one path
                    path = np.arange(self.first[lead] + at - 1, self.first[lead + 1])
                    rows.append(path)
                    counts.append(np.ones(len(path), np.int64))
                    n_out += len(path)
                    if self.size[lead] == self.base + held[lead]:
                        ends[n_out - 1] = who
                    continue
                rows.append(np.array([self.first[lead] + at - 1]))
                counts.append(np.array([len(who)]))
                done = who[self.size[who] == self.base + at]
                if len(done):
                    ends[n_out] = done
                n_out += 1
            else:
                who = self.members(bits)
            on = who[held[who] > at]
            next_row = self.first[on] + at
            posting, lead = np.unique(self.posting[next_row], return_index=True)
            for p, i in zip(posting[::-1].tolist(), lead[::-1].tolist(), strict=True):
                b = self.bitmap[p]
                stack.append((self.as_bits(on[i:i + 1]) if b < 0 else bits & self.bits[b], at + 1))
        return (np.concatenate(rows), np.concatenate(counts), ends) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), ends)


def stops(depth: np.ndarray) -> np.ndarray:
    """For nodes in depth-first order, where the subtree of each ends."""
    out, open_ = np.full(len(depth), len(depth)), []
    for i, d in enumerate(depth.tolist()):
        while open_ and open_[-1][1] >= d:
            out[open_.pop()[0]] = i
        open_.append((i, d))
    return out


def shard_nodes(key, table, depth_of_layer: int):
    """The rows of NODES of one shard and layer. Kind 1: a conversation that goes on, and the node at which it leaves the layer."""
    import pyarrow as pa

    number, layer = (k.as_py() for k in key)
    s = Shard(table, layer, depth_of_layer)
    row, n, ends = s.nodes()
    root = row < 0
    real = np.where(root, 0, row)

    def of(values, at_root):
        return np.where(root, at_root, values[real] if len(values) else at_root)

    depth = of(s.row["pos"] + 1, 0)
    names = [f.split()[0] for f in NODES.split(", ")]
    text = [b",".join(b"%d" % c for c in s.convs[ends[i]].tolist()) if i in ends else None for i in range(len(row))]
    top = mix(np.zeros(1, np.uint64))[0]
    lane = lambda v, r: np.where(root, r, v[real] if len(v) else r).astype(np.uint64).view(np.int64)
    parts = [np.zeros(len(row), np.int32), np.full(len(row), number), np.full(len(row), layer), np.arange(len(row)), stops(depth), lane(s.keys[0], top), lane(s.keys[1], top),
             lane(s.parents[0], top), lane(s.parents[1], top), depth, n, of(s.convs[s.owner], s.convs[0]), of(s.row["words"], 0)]
    kinds = [pa.int32(), *[pa.int64()] * 12]
    out = [pa.table([*[pa.array(x, t) for x, t in zip(parts, kinds, strict=True)], pa.array(text, pa.binary())], names=names)]
    on = np.flatnonzero(s.size > s.base + depth_of_layer)
    if len(on):
        last = s.first[on + 1] - 1
        parts = [np.ones(len(on), np.int32), np.full(len(on), number), np.full(len(on), layer), *[np.zeros(len(on), np.int64)] * 2, s.keys[0][last].view(np.int64), s.keys[1][last].view(np.int64),
                 *[np.zeros(len(on), np.int64)] * 4, s.convs[on], np.zeros(len(on), np.int64)]
        out.append(pa.table([*[pa.array(x, t) for x, t in zip(parts, kinds, strict=True)], pa.nulls(len(on), pa.binary())], names=names))
    return pa.concat_tables(out)


def ends_hashes(nodes: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids that end in each node. The ids stream by, a shard's at a time, in order."""
    def digest(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        now, hashed = None, None
        for b in batches:
            found: tuple[list, list, list] = ([], [], [])
            for k1, k2, ends in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if (k1, k2) != now:
                    if now is not None:
                        for out, x in zip(found, (*now, hashed.hexdigest()), strict=True):
                            out.append(x)
                    now, hashed = (k1, k2), hashlib.sha256(ends)
                else:
                    hashed.update(b"," + ends)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())], names=[*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, hashed.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*KEY, "ends_sha256"])

    rows = nodes.where("ends IS NOT NULL").select(*KEY, "shard", "ends")
    return rows.repartition(tasks(nodes.sparkSession), *KEY).sortWithinPartitions(*KEY, "shard").mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def subtree_sums(valued: DataFrame) -> DataFrame:
    """n_leaves and saved of each node's subtree. valued: shard, layer, seq, stop, key, leaf and saved of the nodes counted."""
    def add(key, table):
        import pyarrow as pa

        table = table.sort_by("seq")
        stop, out = table.column("stop").to_numpy(), []
        for c in ("leaf", "saved"):
            total = np.concatenate([[0], np.cumsum(table.column(c).to_numpy())])
            out.append(pa.array(total[stop] - total[:-1]))
        return pa.table([*[table.column(c) for c in KEY], *out], names=[*KEY, "n_leaves", "saved"])

    sums = valued.groupBy("shard", "layer").applyInArrow(add, "k1 bigint, k2 bigint, n_leaves bigint, saved bigint")
    return sums.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def handed_up(nodes: DataFrame, valued: DataFrame) -> DataFrame:
    """``valued`` with what lies in deeper layers added to the nodes at which its conversations leave a layer."""
    own = valued.groupBy(F.col("low").alias("conv"), "layer").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    leaves = nodes.where("kind = 1").select(F.col("low").alias("conv"), "shard", "layer", *KEY)
    after = W.partitionBy("conv").orderBy(F.desc("layer")).rowsBetween(W.unboundedPreceding, -1)  # one row for each layer of a conversation
    each = leaves.select("conv", "layer").unionByName(own.select("conv", "layer")).distinct().join(own, ["conv", "layer"], "left")
    deeper = each.select("conv", "layer", *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(after), F.lit(0)).alias(c) for c in ("leaf", "saved")])
    extra = leaves.join(deeper, ["conv", "layer"]).groupBy("shard", "layer", *KEY).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    both = valued.join(extra, ["shard", "layer", *KEY], "left")
    return both.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaf", "saved")})


def trie(turns: DataFrame, block: int = 20, most: int = 4, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN, layer: int = DEPTH) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; see the contract in the module's docstring."""
    sequence, convs = rebuilt(stash(numbered(turns, conv_id, turn, role, text)), block, most)
    sequence = stash(sequence)
    zero = F.lit(0).cast("bigint")
    # a row at position -1 stands for the conversation itself
    rows = sequence.join(convs.select("conv", "size"), "conv").unionByName(convs.select("conv", F.lit(-1).cast("bigint").alias("pos"), zero.alias("lo"), zero.alias("hi"), zero.alias("words"), "size"))
    rows = rows.withColumn("shard", F.floor(F.col("conv") / span)).withColumn("layer", F.floor(F.greatest("pos", zero) / layer))
    deep = (convs.agg(F.max("size")).first()[0] or 0) > layer
    if deep:
        rows = rows.join(starts(sequence, convs, layer), ["conv", "layer"], "left").withColumns({x: F.coalesce(x, zero) for x in "abcd"})
    else:
        rows = rows.withColumns({x: zero for x in "abcd"})
    nodes = stash(rows.groupBy("shard", "layer").applyInArrow(lambda key, table: shard_nodes(key, table, layer), NODES))
    made = nodes.where("kind = 0")
    whole = made.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    kids = whole.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    whole = stash(whole.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    counted = made.join(whole.select(*KEY, "conv_id", "n_convs", "n_children"), KEY)
    mine = F.col("low") == F.col("conv_id")
    valued = counted.select("shard", "layer", "seq", "stop", *KEY, "low", F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).cast("bigint").alias("leaf"),
                            F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).cast("bigint").alias("saved"))
    sums = subtree_sums(handed_up(nodes, stash(valued)) if deep else valued)
    parents = whole.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    above = whole.where("depth > 0").join(parents, ["p1", "p2"]).unionByName(whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    out = above.join(sums, KEY).join(ends_hashes(made), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
