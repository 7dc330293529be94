"""Alignment of two tokenizers against whole-text encodings by the libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def whole(rows):
    """The contract, one text at a time."""
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_letters()
    a.encode_special_tokens = True
    bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in a.get_vocab().items()}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for i, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        sides = [[bytes_a[k] for k in x], [bytes_b(k) for k in y]]
        if not t or any(b"".join(s) != (" " + t).encode() for s in sides):
            docs.append((i, None))
            continue
        ends = [np.cumsum([len(k) for k in s]).tolist() for s in sides]
        at = [{e: k for k, e in enumerate(s)} for s in ends]
        groups, links, last = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [at[0][e] + 1, at[1][e] + 1]
            groups.append(",".join(map(str, x[last[0]:to[0]])) + "|" + ",".join(map(str, y[last[1]:to[1]])))
            links.append((x[to[0] - 1], y[to[1] - 1]))
            last = to
        count.update(links)
        docs.append((i, (len(x), len(y), groups, links)))
    best = defaultdict(int)
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n, m, g, links = d
            out.append((i, n, m, len(g), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(";".join(g).encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in alignment.align_documents(docs, A, B).collect()), key=str)


def test_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, " "), (3, "a"), (4, "<|endoftext|> x<|endoftext|>y <s> </s>"), (5, "▁ bad"), (6, "good ▁"), (7, "tab\tand  two\n\nlines"), (8, "é ﬁ  wide 日本語テキスト 😀"), (9, "x" * 5000),
            (10, "word " * 300), (11, "word " * 300), (11, "word " * 300), (12, " lead"), (13, "trail "), (None, "null id"), (14, "a\x00b \x85c"), (15, "  nb"), (16, "long text of words " * 20000)]
    docs = spark.createDataFrame([(*r, "n", "k", "s") for r in rows], "doc_id bigint, text string, n_a string, key string, slice string").repartition(3)
    assert found(docs) == whole(rows)
    assert found(docs.limit(0)) == []


def test_given_table_in_many_parts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs.repartition(40)) == whole(rows)  # more parts than one step of the tree adds up


@pytest.mark.parametrize("n", [0, 1, 5, 20000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    h = alignment.PerfectHash(keys)
    place, known = h.find(keys)
    assert known.all() and sorted(place.tolist()) == list(range(len(keys)))
    others = keys + np.uint64(1)
    assert not h.find(others[~np.isin(others, keys)])[1].any()


def test_held_pieces_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 10)
    aligner = alignment.Aligner(A, B, strings=True)
    first = [f"word{i}" for i in range(9)]
    aligner.places(first)
    texts = {w: aligner.text[aligner.place[w]] for w in first}
    aligner.places([f"other{i}" for i in range(8)])
    again = aligner.places(first)
    assert [aligner.text[p] for p in again] == [texts[w] for w in first]
