"""Bootstraps whose draws go packed to the blocks of trades."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import draw
from tidemark.operators import multiplicity as M


def test_packed_draws_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "PACK_BLOCK", 16)
    monkeypatch.setattr(M, "PACK_ROWS", 40)
    dice = random.Random(2)
    rows = [(k, i, dice.gauss(0.1, 1) if i % 17 else None) for i in range(150) for k in "ab"] + [("c", 1, 0.5)]
    d = spark.createDataFrame(rows, "k string, t bigint, x double")
    got = {r.k: (r.n, r.prob_pf) for r in M.prob_profit_factor(d, "k", ["t"], "x", 1.0, 12, 5, 1000).collect()}
    for k in "ab":
        x = [r[2] for r in rows if r[0] == k]
        to = spark.range(150).selectExpr("id AS _i", f"'{k}' AS k", "explode(sequence(0, 11)) AS rep").select("rep", (F.pmod(draw(5, "rep", "k", "_i"), F.lit(150))).alias("rn")).collect()
        hits = 0
        for rep in range(12):
            drawn = [x[r.rn] for r in to if r.rep == rep and x[r.rn] is not None]
            hits += sum(v for v in drawn if v > 0) > -sum(v for v in drawn if v < 0)
        assert got[k] == (150, pytest.approx(hits / 12))
    assert got["c"] == (1, 0.0)
