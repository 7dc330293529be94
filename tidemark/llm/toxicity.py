"""Toxicity by weak supervision.

Lexicon entries (words, and beginnings of words) are mined from a bounded sample of labelled documents; each must hold
up in two halves of it. They are dealt over voters by kind and strength; patterns of the text's form vote as well. A
generative label model, a tree of voters below the hidden label, estimates by expectation-maximisation over the votes
of all documents how accurate each voter is and how voters depend on each other. A linear classifier on the entries
and patterns is then trained on the posterior labels of a bounded sample of documents and scores every document.

Texts are read whole. A null or empty text gets the score of a text without any entry. Labels that are null or of
documents in the held-out fold are never learnt from; of several labels of a document the highest counts. Without
labels of both classes all scores are 0. Repeated rows are scored one by one; an empty table gives no rows; other
columns play no part, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import coded_words
from tidemark.llm.common import Words, columns_of, fold, pieces, ranges, stash

#: Labelled documents of each class to mine at most, and documents to train the classifier on.
MINED, TRAINED = 2500, 20_000
#: Lexicon entries at most, the least weight of evidence (log odds less its standard error) in each half of the sample,
#: and the lengths of the word beginnings.
ENTRIES, EVIDENCE, BEGINNINGS = 4096, 1.5, (4, 5, 6)
TIERS = 3
#: Voters on the form of a text.
PATTERNS = (r"!!+", r"\b[A-Z]{4,}\b[^a-z]*\b[A-Z]{4,}\b", r"\b[A-Za-z]\*{2,}[A-Za-z]?", r"(?i)\b(you are|you're|du bist|eres|tu es) (a|an|ein|eine|un|une)\b")
BATCH_BYTES = 16 << 20
WORDS = re.compile(r"[^\W\d_]+")


def entries_of(word: str) -> list[str]:
    """A raw word's entries: its words in lower case, and their beginnings (with a star)."""
    out = []
    for w in WORDS.findall(word.lower()):
        if len(w) <= 24:
            out.append(w)
        out += [w[:n] + "*" for n in BEGINNINGS if len(w) >= n]
    return out


def text_slices(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield from pieces(pa.Table.from_batches([batch]), "text", BATCH_BYTES)


def with_least_pair(sample: DataFrame) -> DataFrame:
    """Add ``least``, the least hash of two neighbouring words (in lower case) of each text."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in text_slices(batches):
            pairs, first = Words(part.column("text").combine_chunks(), lower=True).windows(2)
            padded = np.concatenate([pairs, np.full(1, ~np.uint64(0))])
            least = np.where(np.diff(first) > 0, np.minimum.reduceat(padded, first[:-1]) if len(first) > 1 else [], ~np.uint64(0))
            yield from part.append_column("least", pa.array(least.astype(np.int64))).to_batches()

    return sample.mapInArrow(add, columns_of(sample) + ", least bigint")


def mine(sample: DataFrame) -> list[tuple[str, float]]:
    """The lexicon: entries and their weight of evidence, strongest first. sample: text, toxic, half (0 or 1)."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in text_slices(batches):
            found: dict[str, np.ndarray] = {}
            for text, toxic, half in zip(*[part.column(c).to_pylist() for c in ("text", "toxic", "half")], strict=True):
                for e in {e for w in set((text or "").split()) for e in entries_of(w)}:
                    found.setdefault(e, np.zeros(4, np.int64))[2 * half + toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([v[i] for v in found.values()], pa.int64()) for i in range(4)]], names=["entry", "c0", "t0", "c1", "t1"])

    n = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    if any((h, y) not in n for h in (0, 1) for y in (0, 1)):
        return []
    counts = sample.mapInArrow(count, "entry string, c0 bigint, t0 bigint, c1 bigint, t1 bigint").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])

    def evidence(h: int) -> F.Column:
        t, c = F.col(f"t{h}"), F.col(f"c{h}")
        odds = F.log((t + 0.5) / (n[h, 1] + 1.0)) - F.log((c + 0.5) / (n[h, 0] + 1.0))
        return odds - F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))

    strong = counts.where(F.col("t0") + F.col("t1") >= 4).withColumn("weight", F.least(evidence(0), evidence(1))).where(F.col("weight") >= EVIDENCE)
    return [(r.entry, r.weight) for r in strong.orderBy(F.desc("weight"), "entry").limit(ENTRIES).collect()]


def voter_of(lexicon: list[tuple[str, float]]) -> np.ndarray:
    """The voter of each entry: by kind (word, or length of the beginning) and by tier of strength."""
    kind = np.array([1 + BEGINNINGS.index(len(e) - 1) if e.endswith("*") else 0 for e, _ in lexicon], int)
    out = np.zeros(len(lexicon), int)
    for k in range(len(BEGINNINGS) + 1):
        mine_ = np.flatnonzero(kind == k)  # strongest first
        out[mine_] = k * TIERS + np.arange(len(mine_)) * TIERS // max(1, len(mine_))
    return out


VOTERS = (len(BEGINNINGS) + 1) * TIERS + len(PATTERNS)


def votes(docs: DataFrame, lexicon: list[tuple[str, float]]) -> DataFrame:
    """doc_id, held_out, entries (numbers of the lexicon entries and patterns met) and mask (a bit for each voter) of every document."""
    number = {e: i for i, (e, _) in enumerate(lexicon)}
    voters = np.concatenate([voter_of(lexicon), (len(BEGINNINGS) + 1) * TIERS + np.arange(len(PATTERNS))]).astype(np.int64)

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in text_slices(batches):
            texts = pc.fill_null(part.column("text").combine_chunks().cast(pa.large_string()), "")
            first, code, words = coded_words(texts)
            own = [sorted({number[e] for e in entries_of(w) if e in number}) for w in words.to_pylist()]
            size = np.array([len(x) for x in own], np.int64)
            flat, begin = np.array([e for x in own for e in x], np.int64), np.cumsum(size) - size
            doc = np.repeat(np.arange(len(texts)), np.diff(first))
            met = np.flatnonzero(size[code] > 0)
            pair = [np.repeat(doc[met], size[code[met]]) * (1 << 20) + flat[ranges(begin[code[met]], size[code[met]])]]
            for i, p in enumerate(PATTERNS):
                pair.append(np.flatnonzero(pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False)).astype(np.int64) * (1 << 20) + len(number) + i)
            pair = np.unique(np.concatenate(pair))
            doc, entry = pair >> 20, pair & ((1 << 20) - 1)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            mask = np.zeros(len(texts), np.int64)
            np.bitwise_or.at(mask, doc, np.int64(1) << voters[entry])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), part.column("held_out").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), pa.array(entry.astype(np.int32))), pa.array(mask)], names=["doc_id", "held_out", "entries", "mask"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(vote, f"doc_id {kind}, held_out boolean, entries array<int>, mask bigint")


class LabelModel:
    """P(votes, label): the label has a rate; each voter depends on the label and on one other voter, its parent in a tree."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, labelled: dict[int, dict[int, int]], rounds: int = 25):
        """masks, counts: distinct votes and how many documents cast them; labelled: for 0 and 1, the same of labelled ones."""
        self.fires = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        known = np.array([[labelled[y].get(int(m), 0) for y in (0, 1)] for m in masks], float).reshape(-1, 2)
        share = (known.sum(axis=0) + 1) / (known.sum() + 2)
        posterior = np.tile(share, (len(masks), 1))
        seen = known.sum(axis=1) > 0
        posterior[seen] = (known[seen] + share) / (known[seen].sum(axis=1, keepdims=True) + 1)
        known = known * max(1.0, counts.sum() / max(known.sum(), 1.0))  # labelled documents weigh as much as the others together
        for _ in range(rounds):
            weight = counts[:, None] * posterior + known
            self.fit(weight)
            posterior = self.posterior(self.fires)
        self.weight = weight

    def fit(self, weight: np.ndarray) -> None:
        total = weight.sum(axis=0)
        self.rate = np.log((total + 1) / (total.sum() + 2))
        x = self.fires
        pair = np.stack([np.stack([(u.T * w) @ v for v in (1 - x, x)]) for w in weight.T for u in (1 - x, x)]).reshape(2, 2, 2, VOTERS, VOTERS) + 0.1
        # pair[y, a, b, i, j]: documents of label y where voter i votes a and voter j votes b
        joint = pair / pair.sum(axis=(1, 2), keepdims=True)
        single = joint.sum(axis=2, keepdims=True), joint.sum(axis=1, keepdims=True)
        shared = ((joint * np.log(joint / (single[0] * single[1]))).sum(axis=(1, 2)) * np.exp(self.rate)[:, None, None]).sum(axis=0)
        self.parent = spanning_tree(shared)
        self.correlation = shared
        self.table = np.zeros((2, VOTERS, 2, 2))  # log P(vote b of voter | label y, vote a of its parent)
        for i, p in enumerate(self.parent):
            found = pair[:, :, :, p, i] if p >= 0 else np.repeat(pair[:, :, :, 0, i].sum(axis=1, keepdims=True), 2, axis=1)
            self.table[:, i] = np.log((found + 0.1) / (found + 0.1).sum(axis=2, keepdims=True))
        fires = pair[:, 1, 1][:, np.arange(VOTERS), np.arange(VOTERS)]
        self.accuracy = fires[1] / fires.sum(axis=0)  # P(label 1 | the voter votes)

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        x = fires.astype(int)
        logs = np.tile(self.rate, (len(x), 1))
        for i, p in enumerate(self.parent):
            for y in (0, 1):
                logs[:, y] += self.table[y, i][x[:, p] if p >= 0 else 0, x[:, i]]
        e = np.exp(logs - logs.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def spanning_tree(weight: np.ndarray) -> list[int]:
    """Parents of the tree of most weight (the first voter is the root; -1)."""
    n = len(weight)
    parent, best, inside = [-1] * n, weight[0].copy(), np.zeros(n, bool)
    inside[0] = True
    source = np.zeros(n, int)
    for _ in range(n - 1):
        j = int(np.where(inside, -np.inf, best).argmax())
        parent[j], inside[j] = int(source[j]), True
        nearer = weight[j] > best
        best[nearer], source[nearer] = weight[j][nearer], j
    return parent


def train_linear(entries: list[list[int]], labels: np.ndarray, size: int, penalty: float = 2e-6, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient steps over sparse rows."""
    row = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
    column = np.array([i for e in entries for i in e], np.int64)
    n = len(entries)
    w, bias, vw, vb = np.zeros(size), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))), np.zeros(size), 0.0
    longest = max([len(e) for e in entries], default=0) + 1
    step = 4.0 * n / (longest * max(1.0, np.bincount(column, minlength=1).max(initial=0)))
    step = min(step, 50.0)
    for i in range(rounds):
        hold = i / (i + 3.0)
        lw, lb = w + hold * vw, bias + hold * vb
        p = 1 / (1 + np.exp(-(np.bincount(row, lw[column], n) + lb)))
        error = (p - labels) / n
        gw, gb = np.bincount(column, error[row], size) + penalty * lw, error.sum()
        nw, nb = lw - step * gw, lb - min(step, 4.0) * gb
        w, bias, vw, vb = nw, nb, nw - w, nb - bias
    return w, bias


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), fold(doc_id, folds).alias("fold"), F.col(text).alias("text")).withColumn("held_out", F.col("fold") == held).drop("fold")
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(doc_id, folds) != held))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    each = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MINED) for y in (0, 1)]
    chosen = stash(each[0].unionByName(each[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")))
    # of copies and near copies, which mostly share the least hash of their word pairs, one counts: else their words look like evidence
    sample = with_least_pair(named.join(F.broadcast(chosen), "doc_id")).dropDuplicates(["least", "toxic"])  # 2 * MINED ids at most
    sample = stash(sample.drop("least"))
    lexicon = mine(sample)
    cast = stash(votes(named.select("doc_id", "held_out", "text"), lexicon))
    patterns = cast.groupBy("mask").count().collect()  # 2 ** VOTERS at most, and no more than documents
    by_label = cast.where(~F.col("held_out")).join(F.broadcast(chosen), "doc_id").groupBy("mask", "toxic").count().collect()
    labelled = {y: {r["mask"]: r["count"] for r in by_label if r.toxic == y} for y in (0, 1)}
    size = len(lexicon) + len(PATTERNS)
    if not labelled[0] or not labelled[1]:
        weights, bias = np.zeros(size), -np.inf
    else:
        masks = np.array([r["mask"] for r in patterns], np.int64)
        model = LabelModel(masks, np.array([r["count"] for r in patterns], float), labelled)
        soft = dict(zip(masks.tolist(), model.posterior(model.fires)[:, 1].tolist(), strict=True))
        some = cast.where(~F.col("held_out")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINED).select("entries", "mask").collect()  # TRAINED short rows at most
        weights, bias = train_linear([r.entries for r in some], np.array([soft[r["mask"]] for r in some]), size)
    model_ = spark.sparkContext.broadcast((weights, float(bias)))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w, b = model_.value
        for batch in batches:
            entries = batch.column("entries")
            n = entries.value_lengths().to_numpy()
            margin = np.bincount(np.repeat(np.arange(len(n)), n), w[entries.flatten().to_numpy()], len(n)) + b
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700))) if np.isfinite(b) else np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return cast.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", doc_id)
