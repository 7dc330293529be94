"""Detector operators on hand-made rows and against plain loops."""

import numpy as np
import pytest

from tidemark.operators import detectors as X
from tidemark.operators.blocks import sequence


@pytest.mark.parametrize("seed", range(3))
def test_shock_levels_against_a_loop(spark, seed):
    dice = np.random.default_rng(seed)
    t = np.sort(dice.integers(0, 400, 300))
    rows = [(int(a), f"s{i:03d}", float(dice.normal())) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "t bigint, name string, x double").repartition(4)
    got = {r["name"]: r["level"] for r in X.shock_levels(df, clock="t", order=["name"], x="x", span=50, q=0.9, least=12).collect()}
    assert len(got) == 300
    for i, (a, name, _) in enumerate(rows):
        prior = [abs(v) for b, _, v in rows[:i] if b >= a - 50]
        assert got[name] is None if len(prior) < 12 else np.isclose(got[name], np.quantile(prior, 0.9))


def test_dislocation_waits_for_the_slowest_name(spark):
    dice, rows = np.random.default_rng(5), []
    for day in range(12):
        for k in range(9):
            hit = day == 11 and k == 3
            rows.append((day, f"n{k}", 9.0 if hit else float(dice.normal(0, 0.1)), 8.0 if hit else float(dice.normal(0, 0.1)), 50.0 if hit else float(dice.normal(0, 0.1)), day * 10 + k))
    rows.append((11, "late", None, None, None, 999))  # contributes nothing
    df = spark.createDataFrame(rows, "day bigint, name string, residual double, basis double, flow double, known bigint")
    d = X.dislocation(df, at="day", name="name", residual="residual", basis_z="basis", flow="flow", available="known", window=10)
    got = [(r["day"], r["name"], r["known_at"], r["trigger_sign"]) for r in d.where("dislocated").collect()]
    assert got == [(11, "n3", 118, 1.0)]


def test_deleveraging_needs_all_four(spark):
    base = [(i, 0.01 * (-1) ** i, 0.0, 1.0 + i % 3, 10.0 + i % 4) for i in range(20)]
    tail = [(20, -0.2, -0.05, 9.0, 99.0), (21, -0.9, 0.0, 9.5, 99.5), (22, -0.9, -0.05, 0.1, 99.9), (23, 0.9, -0.05, 9.9, 99.9)]
    df = spark.createDataFrame([("a", *r) for r in base + tail], "k string, t bigint, res double, doi double, sells double, vol double")
    s = X.deleveraging(sequence(df, ["k"], ["t"], back=20), residual="res", oi_change="doi", sells="sells", volume="vol", window=20)
    assert [r["t"] for r in s.result().where("deleveraging").collect()] == [20]


def test_flush_reads_the_funding_before(spark):
    df = spark.createDataFrame([("a", i, 100.0 - 5 * i, 50.0 - 2 * i, 0.02 if i < 2 else -0.01) for i in range(8)], "k string, t bigint, oi double, px double, fund double")
    run = lambda **o: [r["t"] for r in X.flush(sequence(df, ["k"], ["t"], back=4), oi="oi", price="px", funding="fund", **o).result().where("flush").orderBy("t").collect()]
    assert run() == [4, 5, 6, 7] and run(least_funding=0.01) == [4, 5]
