"""The parts that run inside tasks, against plain Python."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import bitsliced, bpe, graph_search, language, ngram_join, tokens, toxicity
from tidemark.llm.common import Words

ODD = ["", None, " ", "  two  spaces ", "a<|endoftext|> b", "x y　 z", "end ", " start", "tab\t next", "\n\n lines \n", "it's don't <|startoftext|>x İstanbul ΣΑΣ é ́a", "a\x85 b", "1234 567", "a\x1c b \x1fc", "ÀÉ" * 4000, "one"]


def test_words_and_windows():
    texts = ["the cat sat", None, "", " sat  the\ncat sat\t", "the", "a\x0bb\x0cc é x"]
    w = Words(pa.array(texts))
    want = [(t or "").encode().split() for t in texts]
    got = [[w.data[a:b].tobytes() for a, b in zip(w.start[i:j], w.stop[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == want
    runs, first = w.windows(2)
    assert first.tolist() == [0, 2, 2, 2, 5, 5, 9]
    flat = [tuple(x[i:i + 2]) for x in want for i in range(len(x) - 1)]
    assert len(set(flat)) == len(set(runs.tolist())) and all((flat[i] == flat[j]) == (runs[i] == runs[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_piece_lengths_are_the_librarys():
    model = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD] + ["plain words, with commas. And more " * 50]
    got = tokens.piece_lengths(lambda w: [len(e) for e in model.encode_batch_fast(w, add_special_tokens=False)], pa.array(texts, pa.large_string()), {})
    assert got.tolist() == [len(model.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("known", [{}, {"it's": None}])
def test_word_ids_are_the_librarys(known):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = tokens.tokenizer(path)
    known = {w: np.array(model.encode(w, add_special_tokens=False).ids, np.uint32) for w in known}
    first, code, words = bpe.coded_words(pa.array([t or "" for t in ODD]))
    own = bpe.Encoder(path, known)(words.to_pylist())
    piece = bpe.id_pieces(path).to_pylist()
    for t, i, j in zip(ODD, first[:-1], first[1:]):
        ids = [int(x) for c in code[i:j] for x in own[c]]
        assert ids == model.encode(t or "", add_special_tokens=False).ids
        assert " ".join(piece[x] for x in ids) == model.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("rows,dim,spread", [(1, 3, 5), (70, 1, 2), (300, 7, 40), (129, 4, 1)])
def test_bitsliced_selection(rows, dim, spread):
    dice = np.random.default_rng(rows)
    q = dice.integers(-spread, spread + 1, (rows, dim))
    ids = np.arange(rows) * 3
    s = bitsliced.slices(q)
    low = np.frombuffer(s["low"], "<i8")
    maps = np.frombuffer(s["maps"], np.uint8).reshape(dim, -1, -(-rows // 64) * 8)
    found = bitsliced.search_block(ids, q, ids, low, maps, 5)
    for i in range(rows):
        score = q @ q[i]
        want = sorted((-score[j], ids[j]) for j in range(rows) if j != i)[:5]
        got = sorted(zip((-found[2][i]).tolist(), found[1][i].tolist()))
        assert got == [(int(a), int(b)) for a, b in want]


def test_graph_recall_with_copies():
    dice = np.random.default_rng(5)
    v = dice.normal(size=(1500, 16)) * dice.uniform(0.5, 2, (1500, 1))
    v[700:720] = v[3]
    ids = np.arange(1500)
    q = ids % 20 == 0
    a, b, c = graph_search.search_shard(graph_search.pack(ids, v), ids[q], v[q], 20, graph_search.SEARCH_BEAM)
    exact = v[q] @ v.T
    exact[np.arange(q.sum()), ids[q]] = -np.inf
    hit = [np.mean(c[a == i] >= np.sort(s)[-20] - 1e-9) for i, s in zip(ids[q], exact)]
    assert np.mean(hit) >= 0.95
    assert np.allclose(c, [v[i] @ v[j] for i, j in zip(a, b)], rtol=1e-12, atol=1e-12)


def test_dual_traversal_loses_no_link():
    dice = np.random.default_rng(2)
    base = dice.integers(0, 1 << 62, (12, 80)).astype(np.uint64)
    sets = []
    for i in range(120):
        s = base[i % 12].copy()
        s[: dice.integers(0, 9)] = dice.integers(0, 1 << 62)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), ngram_join.BITS // 8), np.uint8)
    for i, s in enumerate(sets):
        at = (s % np.uint64(ngram_join.BITS)).astype(int)
        np.bitwise_or.at(bits[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    tree = ngram_join.Tree(n, bits.view(np.uint64), np.arange(len(sets)))
    got = {tuple(sorted(p)) for p in zip(*[x.tolist() for x in ngram_join.dual_traversal(tree, tree, 90)])}
    want = {(i, j) for i in range(120) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(sorted(p)) for p in want} <= got and len(got) < 120 * 119 / 4
    half = [np.arange(60), np.arange(60, 120)]
    x, y = (ngram_join.Tree(n[h], bits[h].view(np.uint64), h) for h in half)
    i, j = ngram_join.dual_traversal(x, y, 90)
    assert {(a, b) for a, b in (tuple(sorted(p)) for p in want) if a < 60 <= b} <= set(zip(i.tolist(), (j + 60).tolist()))


def test_label_model_finds_the_accurate_voters():
    dice = np.random.default_rng(1)
    y = dice.random(4000) < 0.2
    right = np.full(toxicity.VOTERS, 0.02)
    masks = np.zeros(4000, np.int64)
    for i in range(6):
        masks |= ((dice.random(4000) < np.where(y, 0.7, 0.02)).astype(np.int64) << i)
    masks |= ((masks >> 5) & 1) << 6  # a voter that copies another
    distinct, place, counts = np.unique(masks, return_inverse=True, return_counts=True)
    known = {v: dict(zip(*[x.tolist() for x in np.unique(masks[:200][y[:200] == v], return_counts=True)])) for v in (0, 1)}
    model = toxicity.LabelModel(distinct, counts.astype(float), known)
    p = model.posterior(model.fires)[:, 1][place]
    assert np.mean((p > 0.5) == y) > 0.97 and model.accuracy[0] > 0.8
    assert 5 in (model.parent[6],) or model.parent[5] == 6
    del right


def test_temperature_and_grams():
    margins = np.array([[4.0, 0.0], [0.0, 4.0], [4.0, 0.0], [0.0, 4.0]])
    assert language.temperature(margins, np.array([0, 1, 1, 0])) > language.temperature(margins, np.array([0, 1, 0, 1]))
    found = list(language.grams(["abc", None, "a", "abcabc"]))
    assert [int(n.sum()) for _, n in found] == [6, 0, 1, 15]


def test_ngram_join_in_reach():
    draw = np.random.default_rng(5)
    keys, n = draw.integers(0, 12, 300).astype(np.uint64), draw.integers(1, 40, 300)
    reach = (n * draw.uniform(0.8, 1.2, 300)).astype(np.int64)
    want = [any(i != j and keys[i] == keys[j] and n[i] <= reach[j] and n[j] <= reach[i] for j in range(300)) for i in range(300)]
    assert ngram_join.in_reach(keys, n, reach).tolist() == want and 0 < sum(want) < 300
    assert ngram_join.in_reach(keys[:0], n[:0], reach[:0]).tolist() == []
