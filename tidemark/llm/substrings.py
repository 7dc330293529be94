"""Substring dedup by fixed-block anchors.

Every document is cut into reference blocks of ``window // 2`` words that do not overlap. Their hashes are the index,
which every rolling run of that many words in all documents probes. A run of ``window`` words that two documents share
holds a whole reference block of each of them, so no shared run escapes. Around each hit the windows that contain the
anchor are extended to, compared by 64-bit digests within buckets, and joined to maximal repeats.

A window is removed from a document if it also starts in a document with a smaller id. Texts that are null, empty or
shorter than a window lose nothing; a null id counts as the largest, so such a document keeps nothing that another has
too, and takes nothing from others without id; rows that share an id take nothing from each other. Repeats inside one
document stay. Empty tables give no rows. Columns other than id and text play no part in ``removals`` and pass through
``without_repeats`` whatever they are called.

Nothing here forms pairs of documents: hashes meet in buckets, where a hash that many documents hold costs one entry
for each batch of documents, and each document learns of its own hashes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_IDS, Words, columns_of, dealt, grouped, id_key, only_ids, pieces, rest_of, small_batches, stash, whole_rows

#: Bytes of text handled at once in a task, and bytes of text whose windows one bucket gets.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 256 << 20
#: Buckets at least.
BUCKETS = 64
LOW = np.uint64(0xFFFFFFFF)
ROWS = "bucket int, kind int, doc binary, size binary, keys binary"


def rows(found: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "kind", "doc", "size", "keys"])


def row(bucket: int, kind: int, doc, size, keys) -> tuple:
    return bucket, kind, doc.astype("<i8").tobytes(), size.astype("<u4").tobytes(), keys.tobytes()


def opened(r: dict, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, size and keys of a packed row."""
    return np.frombuffer(r["doc"], "<i8"), np.frombuffer(r["size"], "<u4").astype(np.int64), np.frombuffer(r["keys"], width)


def by_text(batches) -> Iterator:
    """Tables of about BATCH_BYTES of text."""
    import pyarrow as pa

    for batch in batches:
        for part in pieces(pa.Table.from_batches([batch]), "text", BATCH_BYTES):
            yield part


def owners(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.repeat(ids, np.diff(first))


def least_owner(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least owner of each, and each entry's place among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, place, owner)
    return distinct, least, place


def probes(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """Packed rows by bucket. Kind 0: reference blocks, the least document of a batch with each. Kind 1: rolling runs."""

    def cut(batches: Iterator) -> Iterator:
        for part in by_text(batches):
            ids = part.column("doc").to_numpy()
            words = Words(part.column("text").combine_chunks())
            runs, first = words.windows(block)
            owner = owners(first, np.arange(len(ids)))
            bucket = ((runs >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
            keys = (runs & LOW).astype(np.uint32)
            aligned = (np.arange(len(runs)) - first[owner]) % block == 0
            distinct, least, _ = least_owner(runs[aligned], ids[owner[aligned]])
            order = np.argsort(least, kind="stable")
            distinct, least = distinct[order], least[order]
            found = [row(b, 0, o, n, k) for b, o, n, k in dealt(((distinct >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32), least, (distinct & LOW).astype(np.uint32))]
            found += [row(b, 1, ids[o], n, k) for b, o, n, k in dealt(bucket, owner, keys)]
            if found:
                yield rows(found)

    return docs.select("doc", "text").mapInArrow(cut, ROWS)


def hits(probed: DataFrame, buckets: int) -> DataFrame:
    """doc and keys (64 bits: bucket, low hash) of rolling runs that are a reference block of another document.

    Blocks of a bucket come first and are held, one entry for each hash; probes stream past them. The document that
    holds a hash alone gets no hit.
    """

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def send(doc, keys):
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            ends = np.concatenate([edge[1:], [len(doc)]])
            return pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array([keys[i:j].tobytes() for i, j in zip(edge, ends, strict=True)], pa.binary())], names=["doc", "keys"])

        for bucket, own in grouped(batches, "bucket"):
            held, held_docs, index, least, shared = [], [], None, None, None

            def settle():
                nonlocal held, held_docs
                keys, docs = np.concatenate([*held, np.zeros(0, np.uint32)]), np.concatenate([*held_docs, np.zeros(0, np.int64)])
                index, least, _ = least_owner(keys, docs)
                held, held_docs = [index], [least]
                return index, least

            for r in own:
                doc, size, keys = opened(r, "<u4")
                doc = np.repeat(doc, size)
                if r["kind"] == 0:
                    held.append(keys)
                    held_docs.append(doc)
                    if len(held) > 256:
                        settle()
                    continue
                if index is None:
                    index, least = settle()
                    shared = np.zeros(len(index), bool)
                if not len(index):
                    continue
                at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
                hit = (index[at] == keys) & (least[at] != doc)
                shared[at[hit]] = True
                if hit.any():
                    yield send(doc[hit], (keys[hit].astype(np.uint64) | np.uint64(bucket << 32)))
            if index is not None and shared.any():  # the least document of a hash that others hold too
                order = np.argsort(least[shared], kind="stable")
                yield send(least[shared][order], index[shared][order].astype(np.uint64) | np.uint64(bucket << 32))

    return probed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(match, "doc bigint, keys binary")


def extended(docs: DataFrame, window: int, block: int, anchor_buckets: int, buckets: int) -> DataFrame:
    """Packed rows by bucket of the windows around hits. docs: doc, text, hits (list of packed keys)."""

    def cut(batches: Iterator) -> Iterator:
        for part in by_text(batches):
            ids = part.column("doc").to_numpy()
            order = np.argsort(ids, kind="stable")
            part, ids = part.take(order), ids[order]
            words = Words(part.column("text").combine_chunks())
            runs, first = words.windows(block)
            whole, whole_first = words.windows(window)
            keys = ((runs >> np.uint64(32)) % np.uint64(anchor_buckets)) << np.uint64(32) | (runs & LOW)
            near = np.zeros(len(whole) + 1, np.int32)
            for i, found in enumerate(part.column("hits").to_pylist()):
                n = whole_first[i + 1] - whole_first[i]
                if not found or n <= 0:
                    continue
                mine = keys[first[i]:first[i + 1]]
                at = np.flatnonzero(np.isin(mine, np.frombuffer(b"".join(found), "<u8")))
                begin, end = np.clip(at - (window - block), 0, n), np.clip(at + 1, 0, n)
                np.add.at(near, begin + whole_first[i], 1)
                np.add.at(near, end + whole_first[i], -1)
            some = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            owner = owners(whole_first, np.arange(len(ids)))[some]
            digest = whole[some]
            # of documents in one batch only the least sends a window; the others know already that it is not theirs
            distinct, least, place = least_owner(digest, ids[owner])
            later = ids[owner] > least[place]
            late = ids[owner[later]]
            found = [row(b, 0, o, n, k) for b, o, n, k in dealt((late % buckets).astype(np.uint32), late, digest[later])]
            order = np.argsort(least, kind="stable")
            found += [row(b, 1, o, n, k) for b, o, n, k in dealt((distinct[order] % np.uint64(buckets)).astype(np.uint32), least[order], distinct[order])]
            if found:
                yield rows(found)

    return docs.mapInArrow(cut, ROWS)


def repeats(windows: DataFrame, buckets: int) -> DataFrame:
    """doc and keys (64-bit digests) of the windows that start in a document with a smaller id."""

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def send(doc, keys):
            order = np.argsort(doc, kind="stable")
            doc, keys = doc[order], keys[order]
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            ends = np.concatenate([edge[1:], [len(doc)]])
            return pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array([keys[i:j].tobytes() for i, j in zip(edge, ends, strict=True)], pa.binary())], names=["doc", "keys"])

        for _, own in grouped(batches, "bucket"):
            docs, keys = [], []
            for r in own:
                doc, size, k = opened(r, "<u8")
                doc = np.repeat(doc, size)
                if r["kind"] == 0:  # settled within its batch
                    if len(doc):
                        yield send(doc, k)
                    continue
                docs.append(doc)
                keys.append(k)
            if not keys:
                continue
            docs, keys = np.concatenate(docs), np.concatenate(keys)
            _, least, place = least_owner(keys, docs)
            later = docs > least[place]
            if later.any():
                yield send(docs[later], keys[later])

    return windows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(match, "doc bigint, keys binary")


def found_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and keys (list of packed 64-bit digests): the windows that each document has to lose."""
    block = window // 2
    small_batches(docs)
    base = docs.select(id_key(doc_id).alias("doc"), F.col(text).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, ceil(size / BUCKET_BYTES))
    # answers come bucket by bucket; a document's own are few, however many documents share its passages
    answers = stash(hits(probes(base, block, buckets), buckets))
    hit = stash(answers.select("doc").distinct())
    own = answers.groupBy("doc").agg(F.collect_list("keys").alias("hits"))
    around = only_ids(base, "doc", hit).join(own, "doc").select("doc", "text", "hits")
    return repeats(extended(around, window, block, buckets, buckets), buckets).groupBy("doc").agg(F.collect_list("keys").alias("repeats"))


def kept(part, window: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray | None]]:
    """For an Arrow table (text, repeats): each text's bytes, words, and the mask of kept words (None: all of them)."""
    import pyarrow as pa

    lists = part.column("repeats").to_pylist()
    some = [i for i, x in enumerate(lists) if x]
    words = Words(part.column("text").combine_chunks().take(pa.array(some, pa.int64())))
    whole, first = words.windows(window)
    masks = {}
    for j, i in enumerate(some):
        at = np.flatnonzero(np.isin(whole[first[j]:first[j + 1]], np.frombuffer(b"".join(lists[i]), "<u8")))
        edge = np.zeros(words.first[j + 1] - words.first[j] + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        masks[i] = np.cumsum(edge[:-1]) == 0
    for i, raw in enumerate(part.column("text").combine_chunks().cast(pa.large_binary()).to_pylist()):
        yield raw or b"", (raw or b"").split(), masks.get(i)  # split() of bytes cuts at ASCII white space


def removals(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every document."""

    def digest(batches: Iterator) -> Iterator:
        import hashlib
        from itertools import compress

        import pyarrow as pa

        for part in by_text(batches):
            out = []
            for _, words, keep in kept(part, window):
                left = words if keep is None else list(compress(words, keep.tolist()))
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), *[pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return judged(named, window).mapInArrow(digest, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string").withColumnRenamed("doc_id", doc_id)


def without_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the repeated words; those that have no word left are dropped, if they had one before.

    A text that loses words has one space between the others; other texts stay as they are.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), rest_of(docs, text))

    def cut(batches: Iterator) -> Iterator:
        from itertools import compress

        import pyarrow as pa

        for part in by_text(batches):
            texts, stay = part.column("text").to_pylist(), []
            for i, (_, words, keep) in enumerate(kept(part, window)):
                if keep is not None and not keep.all():
                    texts[i] = b" ".join(compress(words, keep.tolist())).decode()
                    if not texts[i]:
                        continue
                stay.append(i)
            at = pa.array(stay, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()).take(at), part.column("rest").combine_chunks().take(at)], names=["text", "rest"])

    return whole_rows(judged(named, window).mapInArrow(cut, columns_of(named.select("text", "rest"))), docs, text)


def judged(docs: DataFrame, window: int) -> DataFrame:
    """docs (doc_id, text, ...) with ``repeats``. Documents that lose nothing are not shuffled while the others' ids fit a broadcast."""
    lost = stash(found_repeats(docs, window))
    ids = stash(lost.select("doc"))
    keyed = docs.withColumn("doc", id_key("doc_id"))
    small = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if small else ids
    losing = keyed.join(ids, "doc", "left_semi").join(lost, "doc")
    others = keyed.join(ids, "doc", "left_anti").withColumn("repeats", F.lit(None).cast("array<binary>"))
    return losing.unionByName(others).drop("doc")
