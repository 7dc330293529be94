"""Token counts: batch encoding in Arrow functions that return lengths only.

A batch holds about ``BATCH_BYTES`` of text. Every text is split at safe boundaries: in front of a single space that
stands between two characters that are no white space. The byte-level splitting pattern never matches across such a
place, and a special string holds no space, so the pieces' tokens are those of the whole text. Pieces that are alike
are encoded once per batch. A text without such a place is one piece, however long.

A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted one by one; an empty table gives no rows;
other columns play no part, whatever they are called. A null key stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces

#: Bytes of text in one batch.
BATCH_BYTES = 8 << 20
#: White space of any kind, as a character class.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A space that has white space or an end of the text beside it.
UNSAFE = rf"(?:^|{BLANK}) | (?:{BLANK}|$)"
SAFE = r"(?<=\S) (?=\S)"


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def encoded(model, words: list[str]) -> Iterator:
    """The library's encodings, a few thousand at a time: each holds far more than its ids."""
    for at in range(0, len(words), 4096):
        yield from model.encode_batch_fast(words[at:at + 4096], add_special_tokens=False)


def piece_lengths(encode, texts, seen: dict) -> np.ndarray:
    """Tokens of each text of an Arrow string array. ``encode``: lengths for a list of strings; ``seen``: its results so far."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False).astype(bool)
    total = np.zeros(len(texts), np.int64)
    for rows, cut in ((np.flatnonzero(~odd), lambda x: pc.split_pattern(x, " ")), (np.flatnonzero(odd), lambda x: pa.array([re.split(SAFE, s) for s in x.to_pylist()], pa.large_list(pa.large_string())))):
        if not len(rows):
            continue
        cut_up = cut(texts.take(pa.array(rows)))
        first = np.asarray(cut_up.offsets)[:-1] - np.asarray(cut_up.offsets)[0]
        coded = cut_up.flatten().dictionary_encode()
        code, words = np.array(coded.indices), coded.dictionary.to_pylist()
        # a piece that does not begin its text has a space in front
        heads = np.unique(code[first])
        spaced = np.zeros(len(words), np.int64)
        later = np.ones(len(code), bool)
        later[first] = False
        used = np.unique(code[later])
        spaced[used] = lengths(encode, [" " + words[i] for i in used], seen)
        plain = np.zeros(len(words), np.int64)
        plain[heads] = lengths(encode, [words[i] for i in heads], seen)
        counts = spaced[code]
        counts[first] = plain[code[first]]
        total[rows] = np.add.reduceat(counts, first)
    return total


def lengths(encode, words: list[str], seen: dict) -> list[int]:
    new = [w for w in words if w not in seen]
    if len(seen) + len(new) > 1 << 19:  # the memory of a task stays bounded; what is forgotten is encoded again
        seen.clear()
        new = words
    seen.update(zip(new, encode(new), strict=True))
    return [seen[w] for w in words]


def token_counts(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document."""

    def count(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        model, seen = tokenizer(path), {}

        def encode(words: list[str]) -> list[int]:
            return [len(e) for e in encoded(model, words)]

        for batch in batches:
            for part in pieces(pa.Table.from_batches([batch]), "text", BATCH_BYTES):
                texts = pc.fill_null(part.column("text").combine_chunks().cast(pa.large_string()), "")
                n = pa.array(piece_lengths(encode, texts, seen))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("doc_id", doc_id)
