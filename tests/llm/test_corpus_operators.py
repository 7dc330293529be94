"""The operators on small tables with nulls, empty and long texts, ties, repeats, clashing columns; against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bitsliced, bpe, graph_search, language, mixing, ngram_join, substrings, tokens, toxicity, url_filters

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, doc string, copies string"


def words(seed, n):
    dice = np.random.default_rng(seed)
    return [f"w{x}" for x in dice.integers(0, 400, n)]


def texts():
    a, b, shared = words(1, 300), words(2, 150), words(3, 70)
    near = a.copy()
    near[10], near[200] = "other", "changed"
    yield from [" ".join(a), " ".join(near), " ".join(a), None, "", "  \t\n", "one", "One", "two words", "TWO  words", " ".join(b + shared), " ".join(shared + words(4, 60)),
                " ".join(words(5, 30) + shared[:49]), " ".join(words(6, 20) + shared[:50] + words(7, 20) + a[100:160]), "\n".join(b), "x" * 30000, " ".join(["same"] * 200), " ".join(["same"] * 120),
                " ".join(words(8, 12000)), "!!! ??? 123"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "c"][i % 4], 1, "x", "y", "z") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[0], rows[0]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sets(rows, k):
    out = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = (t or "").translate(lower).encode().split()
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def classes(found, threshold):
    root = {i: i for i in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in found:
        for j in found:
            if i < j and found[i] and 100 * len(found[i] & found[j]) >= threshold * len(found[i] | found[j]) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in found}


@pytest.mark.parametrize("k,threshold", [(3, 90), (5, 80)])
def test_ngram_join(docs, plain, k, threshold):
    found = sets(plain, k)
    want = classes(found, threshold)
    got = ngram_join.components(docs, k, threshold).collect()
    assert len(got) == len(plain)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(found[i]), want[i]) for i in found}


def test_ngram_join_chain_of_near_copies(spark):
    base = words(11, 200)
    rows = []
    for i in range(40):  # each differs from the next in one word: neighbours link, ends do not
        w = base.copy()
        for j in range(i):
            w[(5 * j) % 200] = f"new{j}"
        rows.append((i * 7 + 1, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_join.components(spark.createDataFrame(rows + [(None, "a b c d")], "doc_id bigint, text string")).collect()}
    want = classes(sets(rows, 3), 90)
    assert {i: got[i] for i, _ in rows} == want and got[None] is None


def test_ngram_join_groups_leave_out_who_cannot_link(spark):
    # families of near copies; the firsts of all families share a shingle rarer than the others, in sets whose sizes are too far apart
    body = lambda i: [f"w{i}x{j}" for j in range(12 * (i + 1))]
    rows = [(100 * i + c, " ".join(([] if c else ["one", "two", "three"]) + body(i))) for i in range(6) for c in range(8)]
    docs = spark.createDataFrame(rows, "doc bigint, text string")
    sketch = spark.sparkContext.broadcast(ngram_join.summed_sketch(ngram_join.sizes_and_sketch(docs, 3)))
    found = ngram_join.candidate_pairs(ngram_join.keyed(docs, 3, 90, sketch, 4), 4).select("a", "b").distinct().collect()
    assert found and all(a // 100 == b // 100 for a, b in found)


def test_one_of_each_and_empty(docs, nothing):
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns and {1, 2}.isdisjoint({r.doc_id for r in kept.collect()})
    assert ngram_join.components(nothing).count() == 0


def removed(rows, window=50):
    first = {}
    cut = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(cut):
        for j in range(len(cut[i]) - window + 1):
            first.setdefault(tuple(cut[i][j:j + window]), i)
    for i, w in cut.items():
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                keep[j:j + window] = [False] * window
        left = [x for x, y in zip(w, keep) if y]
        yield i, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def test_substrings(docs, plain, nothing):
    got = substrings.removals(docs).collect()
    assert len(got) == len(plain) and {tuple(r) for r in got} == set(removed(plain))
    assert substrings.removals(nothing).count() == 0
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert 2 not in left and left[0] == dict(plain)[0] and left[4] == "" and left[3] is None
    assert {i: hashlib.sha256(" ".join((left.get(i) or "").split()).encode()).hexdigest() for i in (11, 13, 14)} == {i: h for i, _, _, h in removed(plain) if i in (11, 13, 14)}


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    size = {s: sum(r["size"] for r in x) for s, x in by.items()}
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    rest = 1.5 * sum(size.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            rest -= 2 * size[s]
        open_ -= full
    target |= share
    for s, x in by.items():
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.copies <= 2 for r in x)
        rate = target[s] / size[s]
        assert all(abs(r.copies - rate) < 1 for r in x)
        assert abs(sum(r.copies * r["size"] for r in x) - target[s]) <= 2 * max(r["size"] for r in x)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_tokens(docs, plain, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokens.tokenizer(path)
    got = tokens.token_counts(docs, path, 1024).collect()
    n = {i: len(model.encode(t or "", add_special_tokens=False)) for i, t in plain}
    assert len(got) == len(plain) and {tuple(r) for r in got} == {(i, len((t or "").encode()), n[i], n[i] > 1024) for i, t in plain}
    assert tokens.token_counts(nothing, path, 1024).count() == 0


@pytest.mark.parametrize("most", [5, 1000])
def test_bpe(docs, plain, nothing, most, monkeypatch):
    monkeypatch.setattr(bpe.frequent_words, "__defaults__", ("text", most, bpe.WORD_BYTES))
    path = public_tokenizers.path("word_bpe_49k.json")
    model = tokens.tokenizer(path)
    want = {i: (model.encode(t or "", add_special_tokens=False).ids) for i, t in plain}
    got = bpe.encode_documents(docs, path).collect()
    assert len(got) == len(plain)
    for r in got:
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) and r.decoded == model.decode(r.ids, skip_special_tokens=False)
    for r in bpe.encode_documents(docs, path, digests=True).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(want[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(nothing, path).count() == 0


def vectors(spark):
    dice = np.random.default_rng(3)
    v = dice.normal(size=(200, 5)).round(2)
    v[50:90] = v[7]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(200, None, "x"), (220, [1.0, None, 0.0, 0.0, 0.0], "x"), (240, [float("nan")] * 5, "x"), (260, [float("inf")] + [0.0] * 4, "x"), (280, [], "x"), (300, [0.0] * 5, "x"), (None, [1.0] * 5, "x"), (320, [1.0, 2.0], "x"), (340, [2.0, 1.0], "x")]
    return spark.createDataFrame(rows + rows[:3], "vec_id bigint, embedding array<double>, rank string"), rows


def brute(rows, quantised, zero):
    own = {i: x for i, x, _ in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and (zero or any(x))}
    f = (lambda x: np.floor(64 * np.array(x)).astype(np.int64)) if quantised else np.array
    for q in own:
        if q % 20 == 0:
            found = sorted((-(f(own[q]) * f(x)).sum(), i) for i, x in own.items() if i != q and len(x) == len(own[q]))[:20]
            yield from ((q, k + 1, i, -s) for k, (s, i) in enumerate(found))


def test_top_k(spark):
    df, rows = vectors(spark)
    assert {tuple(r) for r in bitsliced.top_k(df, rows=64, queries=4).collect()} == set(brute(rows, True, True))
    assert bitsliced.top_k(df.where("false")).count() == 0


def test_neighbours(spark):
    df, rows = vectors(spark)
    got = {tuple(r)[:3]: r.score for r in graph_search.nearest(df, shard=64).collect()}
    want = {x[:3]: x[3] for x in brute(rows, False, False)}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(abs(got[x] - want[x]) < 1e-12 for x in got.keys() & want.keys())
    assert graph_search.nearest(df.where("false")).count() == 0


def test_url_filters(spark):
    rules = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/f", "block"), (None, "/", "block"), ("a.b", "", "block")]
    urls = [None, "", "nothing", "http://", "http://x.net", "http://x.net/", "HTTP://A.EXAMPLE.NET/en/x?y=1#z", "http://example.net/EN/", "http://notexample.com/de/", "ftp://w.example.com/de/?q", "http://x.org/fr/a#b", "http://x.org/foo", "http://a.b", "http://c.a.b?x://y", "x://" + "l." * 300 + "net/" + "p/" * 4000, "http://ü.NET/é\n/x"]
    pages = [(i, u, "h", "v") for i, u in enumerate(urls)]
    df = spark.createDataFrame(pages + [pages[6], (None, urls[5], "h", "v")], "page_id bigint, url string, host string, verdict string")
    got = {tuple(r) for r in url_filters.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}

    def judge(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), v, h.lower() + p) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)] if host else []
        best = max(fit, default=(0, "allow", None))
        return host, path, best[2], best[1]

    assert got == {(i, *judge(u)) for i, u in enumerate(urls)} | {(None, *judge(urls[5]))}
    assert url_filters.judge_urls(df.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_language(spark, docs, nothing):
    dice = np.random.default_rng(4)
    stems = {"en": ["the", "and", "ing", "tion"], "de": ["der", "und", "sch", "ung"], "fr": ["les", "que", "eau", "ment"]}
    rows = [(i, " ".join("".join(dice.choice(stems[g], 2)) for _ in range(25)), g, "s", 1, "x", "y", "z") for i in range(240) for g in [list(stems)[i % 3]]]
    rows += [(300, None, "en", None, 1, "", "", ""), (301, "12 !? 3", "en", None, 1, "", "", ""), (302, rows[0][1], None, None, 1, "", "", ""), rows[0], (None, rows[1][1], "de", None, 1, "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 300}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id in lang]) >= 0.95
    by = {r.doc_id: r for r in got}
    assert by[300].lang_pred == by[301].lang_pred == "und" and by[302].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert language.identify(nothing).count() == 0
    alone = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in alone} == {"und"}


def test_toxicity(spark, docs, nothing):
    dice = np.random.default_rng(6)
    bad = [f"vile{x}" for x in "abcdefgh"] + ["grubby", "nasty"]
    rows, labels = [], []
    for i in range(400):
        w = [f"v{x}" for x in dice.integers(0, 3000, 60)]
        if i % 5 == 0:
            for j in dice.choice(60, 3, replace=False):
                w[j] = str(dice.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 1, "x", "y", "z"))
        labels.append((i, None if i % 7 == 3 else int(i % 5 == 0), "t"))
    rows += [(500, None, None, None, None, "", "", ""), (501, "", None, None, None, "", "", ""), rows[0]]
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [labels[1], (None, 1, "t")], "doc_id bigint, toxic int, text string")
    got = toxicity.toxicity(df, known).collect()
    assert len(got) == len(rows)
    judged = [(r.predicted, int(r.doc_id % 5 == 0)) for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([a == b for a, b in judged]) >= 0.97 and all((r.score >= 0.7) == (r.predicted == 1) for r in got)
    assert {r.predicted for r in got if r.doc_id in (500, 501)} == {0}
    assert toxicity.toxicity(nothing, known).count() == 0
    assert {r.score for r in toxicity.toxicity(df, known.where("false")).collect()} == {0.0}
