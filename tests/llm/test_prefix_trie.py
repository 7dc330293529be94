"""The prefix trie against plain dictionaries, with shards and layers cut small."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, conv string, lo string, n string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, block=20, most=4):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    plain = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: z[0])] for c, v in conv.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = plain.get(c - c % block, [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(m) - 1) * len(WORDS.findall(k[-1][1])) if k else 0)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    turns = spark.createDataFrame([(*r, "d", "c", "l", "n") for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in prefix_trie.trie(turns, **options).collect()), key=str)


def made(seed):
    dice, rows = np.random.default_rng(seed), []
    for c in [*range(70), 200, 345]:
        if c in (20, 40):
            continue
        for i in range(int(dice.integers(0, 9))):
            rows.append((c, None if i == 0 and c % 3 == 0 else i, f"r{dice.integers(2)}", f"a b{dice.integers(2)}" + " w" * int(dice.integers(3))))
    return rows + [(None, 1, "x", "y"), (5, 100, None, None), (6, 100, None, ""), (50, 200, "long", "word " * 20000)]


@pytest.mark.parametrize("options", [{}, {"span": 3, "layer": 2}, {"span": 1000, "layer": 1}])
def test_against_dictionaries(spark, options):
    rows = made(len(options))
    assert found(spark, rows, **options) == brute(rows)


def test_copies_and_a_deep_conversation(spark):
    rows = [(c, i, "user", f"t{i % 7}") for c in (0, 1, 2, 700) for i in range(40)] + [(9, 0, "user", "t0"), (9, 0, "user", "t0"), (9, 0, "user", "t0")]
    got = found(spark, rows, span=2, layer=8)
    assert got == brute(rows) and max(r[1] for r in got) == 40


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "a", "b")]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1  # its only turn is replaced by none: the root alone
    assert found(spark, []) == []


def test_given_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = sorted((tuple(r) for r in prefix_trie.trie(turns).collect()), key=str)
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])
