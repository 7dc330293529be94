"""BPE encoding and decoding over a table of distinct words.

Words (runs without ASCII white space) are split and counted over all documents. The most frequent ``TABLE_WORDS`` of
them are encoded once into a table of bounded size, which every task gets; the ids come back to each word's place by
a look-up of the word. Words outside the table, which are rare, are encoded once in each task that meets them.
Normalisation and splitting of this kind of tokenizer never reach across white space, and special strings hold none,
so the ids of the words in order are the ids of the text. Decoding looks each id up in an array of all pieces.

A null or empty text has no ids and decodes to the empty text. Repeated rows are encoded one by one; an empty table
gives no rows; other columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, ranges, small_batches
from tidemark.llm.tokens import encoded, tokenizer

#: Words in the broadcast table at most, and the longest word (bytes) in it: both bound its size (16 MB and the ids).
TABLE_WORDS, WORD_BYTES = 1 << 17, 128
#: Words outside the table that a task keeps, and bytes of text encoded at once.
OWN_WORDS, BATCH_BYTES = 1 << 16, 2 << 20


def coded_words(texts):
    """Arrow strings cut at ASCII white space: offsets of each text's words, the words' codes, the distinct words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.asarray(cut.offsets)
    coded = cut.flatten().dictionary_encode()
    return offsets - offsets[0], np.array(coded.indices), coded.dictionary


def frequent_words(docs: DataFrame, text: str = "text", most: int = TABLE_WORDS, longest: int = WORD_BYTES) -> DataFrame:
    """word and n: the ``most`` frequent words of all documents. Words are counted in each task first."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in pieces(pa.Table.from_batches([batch]), "text", 8 * BATCH_BYTES):
                _, code, words = coded_words(part.column("text").combine_chunks())
                n = np.bincount(code, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n bigint").where(f"word <> '' AND octet_length(word) <= {longest}")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def word_table(words: DataFrame, path: str) -> DataFrame:
    """word and ids of every word, encoded once."""

    def encode(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = tokenizer(path)
        for batch in batches:
            found = [e.ids for e in encoded(model, batch.column("word").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(encode, "word string, ids array<int>")


class Encoder:
    """Ids for distinct words: from those known, else encoded once and kept while there is room."""

    def __init__(self, path: str, known: dict):
        self.model, self.known, self.own = tokenizer(path), known, {}

    def __call__(self, words: list[str]) -> list[list[int]]:
        new = [w for w in words if w not in self.known and w not in self.own]
        if len(self.own) + len(new) > OWN_WORDS:
            self.own.clear()
            new = [w for w in words if w not in self.known]
        self.own.update(zip(new, (np.array(e.ids, np.uint32) for e in encoded(self.model, new)), strict=True))
        return [self.known[w] if w in self.known else self.own[w] for w in words]


class Table:
    """Words and their ids as three flat arrays: a dictionary of as many lists takes each worker many times the room."""

    def __init__(self, words: list[str], ids: list[list[int]]):
        import pyarrow as pa

        self.words = pa.array(words, pa.large_string())
        self.size = np.array([len(x) for x in ids], np.int64)
        self.ids = np.array([i for x in ids for i in x], np.uint32)

    def look_up(self, words, others: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word begin and how many they are; words outside the table go to ``others``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(words.cast(pa.large_string()), self.words)
        missing = at.is_null()
        rest = missing.to_numpy(zero_copy_only=False)
        own = others(words.filter(missing).to_pylist())
        size = np.zeros(len(words), np.int64)
        begin = size.copy()
        known = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[~rest]
        size[~rest], begin[~rest] = self.size[known], (np.cumsum(self.size) - self.size)[known]
        size[rest] = [len(x) for x in own]
        begin[rest] = len(self.ids) + np.cumsum(size[rest]) - size[rest]
        return np.concatenate([self.ids, *own]), begin, size


def id_pieces(path: str):
    """The piece of each id, as an Arrow array in which decoding looks ids up."""
    import pyarrow as pa

    model = tokenizer(path)
    size = model.get_vocab_size(with_added_tokens=True)
    return pa.array([model.id_to_token(i) or "" for i in range(size)], pa.large_string())


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded text; with ``digests`` SHA-256 of both in place of them."""
    spark = small_batches(docs).sparkSession
    table = word_table(frequent_words(docs, text), path).collect()  # TABLE_WORDS rows at most
    known = spark.sparkContext.broadcast(Table([r.word for r in table], [r.ids for r in table]))

    def encode(batches: Iterator) -> Iterator:
        import hashlib
        import os

        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        others, piece = Encoder(path, {}), id_pieces(path)
        for batch in batches:
            for part in pieces(pa.Table.from_batches([batch]), "text", BATCH_BYTES):
                first, code, words = coded_words(part.column("text").combine_chunks())
                flat, begin, size = known.value.look_up(words, others)
                ids = flat[ranges(begin[code], size[code])]  # the ids, back at their words' places
                ends = np.concatenate([[0], np.cumsum(size[code])])[first]
                lists = pa.LargeListArray.from_arrays(pa.array(ends), piece.take(pa.array(ids.astype(np.int64))))
                decoded = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                n = pa.array(np.diff(ends))
                key = part.column("doc_id").combine_chunks()
                if digests:
                    raw = ids.astype("<u4")
                    a = [hashlib.sha256(raw[i:j].tobytes()).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                    b = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded.cast(pa.large_binary())]
                    yield pa.RecordBatch.from_arrays([key, n, pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([key, n, whole, decoded.cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, {columns}").withColumnRenamed("doc_id", doc_id)
