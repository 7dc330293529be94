"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all documents that may be learnt from. The weights are trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (``SAMPLE`` documents at most, dealt over
the languages), a tenth of which only sets the temperature of the probabilities. Every text is read whole.

A text that is null or holds no letter is ``und`` with score 0, and so is every text when nothing can be learnt from.
Repeated rows are judged one by one; an empty table gives no rows; other columns play no part, whatever they are
called. Documents without language, or in the held-out fold, are never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, fold, mix, pieces, rest_of, small_batches, stash, whole_rows

#: Hashed features, and the lengths of n-grams.
FEATURES, GRAMS = 1 << 16, (1, 2, 3)
#: Documents of the training sample at most, in all and for a language, and how often they are gone through.
SAMPLE, EACH, EPOCHS = 6000, 1500, 2
#: Of follow-the-regularised-leader: step, its start, and both penalties.
STEP, START, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Bytes of text handled at once.
BATCH_BYTES = 1 << 20


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of each text and how often it has them."""
    lowered = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in lowered], np.int64)
    ends = np.cumsum(size)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes, run = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        run = run[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1:] + np.uint64(n)
        hashes.append((mix(run) & np.uint64(FEATURES - 1)).astype(np.int64))
    for begin, end in zip(ends - size, ends, strict=True):
        found = np.concatenate([h[begin:max(begin, end - n)] for n, h in enumerate(hashes)])
        if len(found) > FEATURES // 16:
            count = np.bincount(found, minlength=FEATURES)
            which = np.flatnonzero(count)
            yield which, count[which]
        else:
            yield np.unique(found, return_counts=True)


def weighted(which: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length; the term frequency is damped."""
    x = (1 + np.log(count)) * idf[which]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


def text_slices(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield from pieces(pa.Table.from_batches([batch]), "text", BATCH_BYTES)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each feature, and how many documents there are. Each task sums up first."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        have, n = np.zeros(FEATURES + 1, np.int64), 0
        for part in text_slices(batches):
            for which, _ in grams(part.column("text").to_pylist()):
                have[which] += 1
                n += 1
        have[FEATURES] = n
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(have[some])], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    have = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        have[r.feature] = r.n
    return have[:FEATURES], int(have[FEATURES])


class Leader:
    """Follow-the-regularised-leader, one weight vector for each class."""

    def __init__(self, classes: int):
        self.z, self.n, self.bias = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes)), np.zeros(classes)

    def weights(self, which) -> np.ndarray:
        z, n = self.z[which], self.n[which]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((START + np.sqrt(n)) / STEP + L2))

    def learn(self, which, x, label: int) -> None:
        w = self.weights(which)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        before = self.n[which]
        after = before + g * g
        self.z[which] += g - (np.sqrt(after) - np.sqrt(before)) / STEP * w
        self.n[which] = after


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which held-back documents are likeliest, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        # a little weight on all classes keeps the temperature up where no held-back document is misjudged
        p = softmax(margins / np.exp(t))
        right = p[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(right, 1e-12)).mean() - 1e-3 * np.log(np.maximum(p, 1e-12)).mean())

    low, high, r = np.log(1e-3), np.log(1e3), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(sample: DataFrame, languages: list[str], idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (feature x language) and temperature, learnt in one pass of a task over the bounded sample, in a fixed order."""
    place = {x: i for i, x in enumerate(languages)}

    def learn(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, margins, labels = Leader(len(place)), [], []
        for part in text_slices(batches):
            for (which, count), lang, epoch in zip(grams(part.column("text").to_pylist()), part.column("lang").to_pylist(), part.column("epoch").to_pylist(), strict=True):
                x = weighted(which, count, idf)
                if epoch < EPOCHS:
                    model.learn(which, x, place[lang])
                else:
                    margins.append(x @ model.weights(which))
                    labels.append(place[lang])
        w = model.weights(slice(None))
        t = temperature(np.array(margins), np.array(labels, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()]), pa.array([t])], names=["weights", "temperature"])

    held_back = F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(10)) == 0
    passes = sample.withColumn("epoch", F.explode(F.when(held_back, F.array(F.lit(EPOCHS))).otherwise(F.array(*map(F.lit, range(EPOCHS))))))
    row = passes.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", "text")).mapInArrow(learn, "weights binary, temperature double").first()
    return np.frombuffer(row.weights, "<f8").reshape(FEATURES, -1), row.temperature


def fitted(docs: DataFrame, doc_id: str, text: str, lang: str, folds: int, sample: int, each: int):
    """The broadcast model: languages, weights (feature x language), rarity of features, temperature."""
    small_batches(docs)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held_out = fold("doc_id", folds) == 0
    learnable = named.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    have, n = document_frequencies(learnable)
    idf = np.log((1 + n) / (1 + have)) + 1
    turn = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # only the first of each language leave their tasks
    ids = learnable.select("doc_id", "lang").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= each).orderBy("turn", "lang").limit(sample)
    ids = stash(ids.select("doc_id", "lang").distinct())
    chosen = stash(learnable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text"))  # ``sample`` ids at most
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    weights, heat = train(chosen, languages, idf) if languages else (np.zeros((FEATURES, 0)), 1.0)
    return docs.sparkSession.sparkContext.broadcast((languages, (weights * idf[:, None]).astype(np.float32), idf.astype(np.float32), heat))


def judge(texts: list[str | None], model) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    import re

    names, by_feature, rarity, heat = model
    letter = re.compile(r"[^\W\d_]")
    best, score = [], []
    for t, (which, count) in zip(texts, grams(texts), strict=True):
        if not t or not names or not letter.search(t):
            best.append("und")
            score.append(0.0)
            continue
        tf = 1 + np.log(count.astype(np.float32))
        norm = float(np.sqrt(np.square(tf * rarity[which]).sum()))
        p = softmax(np.asarray(tf @ by_feature[which], np.float64) / (norm or 1.0) / heat)
        best.append(names[int(p.argmax())])
        score.append(float(p.max()))
    return best, score


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = SAMPLE, each: int = EACH) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fitted(docs, doc_id, text, lang, folds, sample, each)

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in text_slices(batches):
            best, score = judge(part.column("text").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), part.column("held_out").combine_chunks(), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    named = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == 0).alias("held_out"), F.col(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    out = named.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", doc_id)


def known_language(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = SAMPLE, each: int = EACH) -> DataFrame:
    """The rows whose language is told with at least this probability, as they are; no row is shuffled."""
    model = fitted(docs, doc_id, text, lang, folds, sample, each)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in text_slices(batches):
            best, score = judge(part.column("text").to_pylist(), model.value)
            good = pa.array([b != "und" and s >= least for b, s in zip(best, score, strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(c).combine_chunks().filter(good) for c in ("text", "rest")], names=["text", "rest"])

    named = docs.select(F.col(text).alias("text"), rest_of(docs, text))
    out = named.mapInArrow(keep, columns_of(named))
    return whole_rows(out, docs, text)
