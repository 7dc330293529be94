"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often a pair of ids does so.

Pass 1 encodes and aligns every document and keeps, for each task, its distinct pairs of ids and their counts. The
distinct pairs of all tasks get a minimal perfect hash; each task's counts become a dense vector indexed by it, and the
vectors are summed up in a tree of shuffles. Pass 2 encodes and aligns anew and looks the counts up: a pair's place in
the hash counts only if the key that stands there is the pair.

Two tokens that end together are linked, so the shorter one's bytes are a suffix of the other's. A token has no more
suffixes than bytes: the number of pairs is below the bytes of both vocabularies together, some half a million, however
large the corpus is. So the keys, the hash and the summed vector are broadcast.

Texts are cut in front of single spaces between two characters that are no white space. Neither tokenizer has a token
across such a place (``Aligner`` checks the pieces), so groups do not span it either, and each distinct piece is encoded
and aligned once for many occurrences; about ``KEPT`` pieces are held at a time.

A null or empty text, or one that either tokenizer does not give back byte for byte, has no tokens. Repeated rows each
count. A null id stays null. Empty tables give no rows. Other columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grouped, mix, pieces, ranges, stash
from tidemark.llm.tokens import SAFE, UNSAFE, encoded, tokenizer

#: Bytes of text in one batch, pieces that are held, new pieces handled at once.
BATCH_BYTES, KEPT, CHUNK = 4 << 20, 1 << 19, 4096
#: Slots a key of the perfect hash, slices in which vectors travel, and vectors that one step of the tree adds up.
ROOM, SLICES, FAN = 2, 8, 32
RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class PerfectHash:
    """A minimal perfect hash of distinct keys (uint64): on each level a key that is alone in its slot stays, the others go on."""

    def __init__(self, keys: np.ndarray):
        self.bits, self.before, found, rest, level = [], [], 0, np.asarray(keys, np.uint64), 0
        while len(rest):
            slots = ROOM * len(rest) + 1
            at = self.slot(rest, level, slots)
            once = np.bincount(at, minlength=slots) == 1
            self.bits.append(once)
            self.before.append(found + np.cumsum(once) - once)
            found += int(once.sum())
            rest = rest[~once[at]]
            level += 1
        self.keys = np.zeros(found, np.uint64)
        place, _ = self.find(np.asarray(keys, np.uint64), check=False)
        self.keys[place] = keys

    @staticmethod
    def slot(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(slots)).astype(np.int64)

    def find(self, keys: np.ndarray, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether the key that stands there is the one asked for."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            at = self.slot(keys[left], level, len(bits))
            here = bits[at]
            out[left[here]] = before[at[here]]
            left = left[~here]
        known = np.ones(len(keys), bool)
        known[left] = False
        if check and len(keys):
            known &= (self.keys[out] == keys) if len(self.keys) else False
        return out, known


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each token: ``size`` and ``start`` in ``data``."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)


class Aligner:
    """Encodes and aligns distinct pieces, and holds what it found."""

    def __init__(self, a: str, b: str, strings: bool):
        import sentencepiece

        self.a, self.strings = tokenizer(a), strings
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters, known = byte_letters(), self.a.get_vocab()
        tokens = [b""] * (max(known.values()) + 1)
        for t, i in known.items():
            tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces of this model span words")
        self.vocabularies = Vocabulary(tokens), Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.counts = np.zeros((0, 3), np.int64)  # tokens of a, tokens of b, links
        self.good, self.pairs, self.text = np.zeros(0, bool), np.zeros(0, np.uint64), []

    def places(self, words: list[str]) -> np.ndarray:
        """Numbers of the pieces in what is held now."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > KEPT and self.place:
            self.forget()
            new = words
        if new:
            # pieces that neither begin nor end with white space are encoded side by side, in one text
            plain = [w for w in new if w and w == w.strip() and "▁" not in w]
            if len(plain) < len(new):
                own = set(plain)
                new = plain + [w for w in new if w not in own]
            found = [self.align(new[at:min(at + CHUNK, stop)], joined) for begin, stop, joined in ((0, len(plain), True), (len(plain), len(new), False)) for at in range(begin, stop, CHUNK)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.counts = np.concatenate([self.counts, *[f[0] for f in found]])
            self.good = np.concatenate([self.good, *[f[1] for f in found]])
            self.pairs = np.concatenate([self.pairs, *[f[2] for f in found]])
            self.text += [t for f in found for t in f[3]]
        return np.array([self.place[w] for w in words], np.int64)

    def encodings(self, words: list[str], joined: bool, stop: np.ndarray):
        """Ids of both tokenizers, and the piece of each. ``joined``: the first gets one text; None if its tokens do not end where pieces do."""
        def each(listed):
            n = np.fromiter(map(len, listed), np.int64, len(listed))
            return np.fromiter(chain.from_iterable(listed), np.int64, int(n.sum())), np.repeat(np.arange(len(words)), n)

        second = each(self.b.encode(words, num_threads=1))
        if not joined:
            return each([e.ids for e in encoded(self.a, [" " + w for w in words])]), second
        ids = np.array(self.a.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        here = np.cumsum(self.vocabularies[0].size[ids])
        if here[-1] != stop[-1] or (here[np.searchsorted(here, stop)] != stop).any():
            return None
        return (ids, np.searchsorted(stop, here)), second

    def align(self, words: list[str], joined: bool):
        """Of each piece (with a space in front): counts, whether both tokenizers give it back, pairs in order, groups as text."""
        raw = [(" " + w).encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        base = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        sides = self.encodings(words, joined, base + size)
        if sides is None:
            return self.align(words, False)
        good = np.ones(len(words), bool)
        for (ids, word), v in zip(sides, self.vocabularies, strict=True):
            total = np.bincount(word, weights=v.size[ids], minlength=len(words)).astype(np.int64)
            fit = total == size
            good &= fit
            whole = np.flatnonzero(fit)
            ids = ids[fit[word]]
            got, want = v.data[ranges(v.start[ids], v.size[ids])], data if fit.all() else data[ranges(base[whole], size[whole])]
            if not np.array_equal(got, want):
                good[np.repeat(whole, size[whole])[got != want]] = False
        if joined and not good.all():
            return self.align(words, False)
        ends = []
        # offsets among the good pieces
        for (ids, word), v in zip(sides, self.vocabularies, strict=True):
            keep = good[word]
            ids, word = ids[keep], word[keep]
            ends.append((ids, word, np.cumsum(v.size[ids])))
        (ia, wa, ea), (ib, wb, eb) = ends
        at = np.minimum(np.searchsorted(eb, ea), max(len(eb) - 1, 0))
        both = eb[at] == ea if len(eb) else np.zeros(len(ea), bool)
        pairs = (ia[both].astype(np.uint64) << np.uint64(32)) | ib[at[both]].astype(np.uint64)
        links = np.bincount(wa[both], minlength=len(words))
        counts = np.stack([np.bincount(wa, minlength=len(words)), np.bincount(wb, minlength=len(words)), links], axis=1).astype(np.int64)
        return counts, good, pairs, self.groups(len(words), good, ia, wa, both, ib, wb, np.bincount(at[both], minlength=len(ib)).astype(bool)) if self.strings else []

    def groups(self, n: int, good, ia, wa, cut_a, ib, wb, cut_b) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each piece."""
        side = np.repeat([0, 1], [len(ia), len(ib)])
        cut = np.concatenate([cut_a, cut_b])
        group = np.concatenate([np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b])
        word = np.concatenate([wa, wb])
        order = np.lexsort((side, group))
        last = np.concatenate([word[order][1:] != word[order][:-1], [True]]) if len(order) else np.zeros(0, bool)
        sign = np.where(last, 3, np.where(cut[order], np.where(side[order] == 0, 1, 2), 0))
        marks = (",", "|", ";", "\n")
        whole = "".join([f"{i}{marks[s]}" for i, s in zip(np.concatenate([ia, ib])[order].tolist(), sign.tolist(), strict=True)]).split("\n")
        out = [""] * n
        for i, t in zip(np.flatnonzero(good).tolist(), whole[:-1], strict=True):
            out[i] = t
        return out


def cut_up(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The texts' pieces: where each text's begin, the pieces' numbers in text order, and the distinct pieces."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False).astype(bool)
    plain = pc.split_pattern(texts, " ")
    if odd.any():
        at = np.flatnonzero(odd)
        listed = pa.array([re.split(SAFE, s) for s in texts.take(pa.array(at)).to_pylist()], plain.type)
        take = np.arange(len(texts))
        take[at] = len(texts) + np.arange(len(at))
        plain = pa.concat_arrays([plain, listed]).take(pa.array(take))
    first = np.asarray(plain.offsets)[:-1].astype(np.int64) - int(plain.offsets[0].as_py())
    coded = plain.flatten().dictionary_encode()
    return first, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def aligned_batches(batches: Iterator, aligner: Aligner) -> Iterator:
    """For each batch: its rows, the texts' first pieces, the pieces' numbers with the aligner, and which texts have tokens."""
    import os

    import pyarrow as pa
    import pyarrow.compute as pc

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    for batch in batches:
        for part in pieces(pa.Table.from_batches([batch]), "text", BATCH_BYTES):
            texts = pc.fill_null(part.column("text").combine_chunks().cast(pa.large_string()), "")
            first, code, words = cut_up(texts)
            code = aligner.places(words)[code]
            good = np.bitwise_and.reduceat(aligner.good[code], first) & (pc.binary_length(texts).to_numpy() > 0)
            yield part, first, code, good


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return found, total


def task_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each task: its distinct pairs and their counts, packed."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        aligner = Aligner(a, b, strings=False)
        keys, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, first, code, good in aligned_batches(batches, aligner):
            of_text = np.repeat(good, np.diff(np.concatenate([first, [len(code)]])))
            times = np.bincount(code[of_text], minlength=len(aligner.good))
            times = np.repeat(times, aligner.counts[:, 2])
            used = times > 0
            keys, totals = added([keys, aligner.pairs[used]], [totals, times[used]])
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([totals.tobytes()])], names=["keys", "counts"])

    return rows.select("text").mapInArrow(count, "keys binary, counts binary")


def distinct_pairs(packed: DataFrame) -> np.ndarray:
    """The keys of all tasks. Bounded by the vocabularies, as the module's docstring shows."""
    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = np.zeros(0, np.uint64)
        for b in batches:
            for k in b.column("keys"):
                seen = np.union1d(seen, np.frombuffer(k.as_py(), np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64))], names=["key"])

    return np.sort(np.asarray(packed.select("keys").mapInArrow(unpack, "key bigint").distinct().toArrow().column("key"), np.int64).view(np.uint64))


def summed_vectors(packed: DataFrame, hashed) -> np.ndarray:
    """The tasks' counts as dense vectors in the order of the hash, summed up in a tree, slice by slice."""
    def dense(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        h = hashed.value
        total = np.zeros(len(h.keys), np.int64)
        for b in batches:
            for k, n in zip(b.column("keys"), b.column("counts"), strict=True):
                place, known = h.find(np.frombuffer(k.as_py(), np.uint64))
                if not known.all():
                    raise ValueError("a pair is missing from the hash")
                total[place] += np.frombuffer(n.as_py(), np.int64)
        if total.any():
            part = TaskContext.get().partitionId()
            cut = np.array_split(total, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int64()), pa.array([x.tobytes() for x in cut])], names=["slice", "part", "sums"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for node, own in grouped(batches, "node"):
            total, place = None, None
            for r in own:
                x, place = np.frombuffer(r["sums"], np.int64), r
                total = x.copy() if total is None else total + x
            yield pa.RecordBatch.from_arrays([pa.array([place["slice"]], pa.int32()), pa.array([place["part"] // FAN], pa.int64()), pa.array([total.tobytes()])], names=["slice", "part", "sums"])

    schema = "slice int, part bigint, sums binary"
    vectors, width = packed.mapInArrow(dense, schema), max(packed.count(), 1)
    while width > 1:
        nodes = SLICES * -(-width // FAN)
        vectors = vectors.withColumn("node", F.floor(F.col("part") / FAN) * SLICES + F.col("slice")).repartition(min(nodes, 200), "node").sortWithinPartitions("node").mapInArrow(add, schema)
        width = -(-width // FAN)
    out: dict[int, np.ndarray] = {}
    for r in vectors.collect():  # SLICES rows, or as many again where a task came late
        x = np.frombuffer(r.sums, np.int64)
        out[r["slice"]] = out.get(r["slice"], 0) + x
    return np.concatenate([out[i] for i in range(SLICES)]) if out else np.zeros(0, np.int64)


def align_documents(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the columns RESULT of every document; ``a``: a byte-level tokenizer's file, ``b``: a sentencepiece model."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    packed = stash(task_counts(rows, a, b))
    hashed = PerfectHash(distinct_pairs(packed))
    counts = summed_vectors(packed, spark.sparkContext.broadcast(hashed))
    # what a pair's second id reaches at most
    second = (hashed.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    top = np.zeros(int(second.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, second, counts)
    known = spark.sparkContext.broadcast((hashed, counts, counts == top[second]))

    def look_up(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        h, count, best = known.value
        aligner = Aligner(a, b, strings=True)
        for part, first, code, good in aligned_batches(batches, aligner):
            used = np.unique(code)
            link = aligner.counts[:, 2]
            begin = np.cumsum(link) - link
            place, there = h.find(aligner.pairs[ranges(begin[used], link[used])])
            word = np.repeat(np.arange(len(used)), link[used])
            sums = np.zeros((len(link), 2), np.int64)
            for k, value in enumerate((best, count)):
                # a pair that is not in the hash belongs to texts without tokens only
                mine = np.zeros(len(used), np.int64)
                np.add.at(mine, word, np.where(there, value[place] if len(value) else 0, 0))
                sums[used, k] = mine
            each = np.concatenate([aligner.counts[:, [0, 1, 2, 2]], sums], axis=1)
            total = np.where(good[:, None], np.add.reduceat(each[code], first, axis=0), 0)
            held, last = aligner.text, np.concatenate([first[1:], [len(code)]]).tolist()
            listed = code.tolist()
            digest = [hashlib.sha256(";".join([held[c] for c in listed[s:e]]).encode()).hexdigest() if g else "" for s, e, g in zip(first.tolist(), last, good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), *[pa.array(total[:, k]) for k in range(6)], pa.array(digest, pa.string())], names=["doc_id", *[f.split()[0] for f in RESULT.split(", ")]])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(look_up, f"doc_id {kind}, {RESULT}").withColumnRenamed("doc_id", doc_id)
