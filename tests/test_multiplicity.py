"""Mergeable path sums, placebos over blocks, drawdowns in blocks, regressions from sums."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import multiplicity as M


def newey_west(x, lag):
    e = x - x.mean()
    s = e @ e / len(x) + sum(2 * (1 - k / (lag + 1)) * (e[k:] @ e[:-k]) / len(x) for k in range(1, min(lag, len(x) - 1) + 1))
    return x.mean() / np.sqrt(max(s, 1e-18) / len(x))


@pytest.mark.parametrize("cuts", [(), (3,), (1, 2, 3), (5, 5, 30), (40, 41, 80)])
def test_path_sums_merge(cuts):
    x = np.random.default_rng(len(cuts)).normal(0.1, 1, (90, 4)).cumsum(axis=0) * 0.1
    parts = [M.Path(p, 7) for p in np.split(x, cuts)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.then(p)
    assert np.allclose(whole.t(), [newey_west(x[:, i], 7) for i in range(4)])


def test_grid_placebo_does_not_depend_on_blocks(spark):
    dice, rows = np.random.default_rng(0), []
    for day in range(70):
        for name in range(6):
            ret = None if dice.random() < 0.1 else float(dice.normal(0, 0.01))
            rows.append((day, name, ret, [float(w) for w in dice.normal(size=2)], [0.1, 0.2], [bool(day % 9), True]))
    df = spark.createDataFrame(rows, "day bigint, place bigint, ret double, weights array<double>, paid array<double>, ok array<boolean>").repartition(5)
    run = lambda block, least: M.grid_placebo(df, at="day", place="place", ret="ret", cost="paid", weights="weights", ok="ok", lags=[3, 12], reps=5, least=least, block=block).toPandas().sort_values("rep").reset_index(drop=True)
    a, b = run(1000, [1, 1]), run(4, [1, 1])
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    # the first configuration alone, by hand: all days, returns dealt to other names of the day
    only = run(8, [1, 1000])
    frame = pd.DataFrame(rows, columns=["day", "place", "ret", "w", "paid", "ok"])
    for rep in range(5):
        gross, paid = [], []
        for day, g in frame.groupby("day"):
            if not g["ok"].iloc[0][0]:
                continue
            have = g[g["ret"].notna()]
            keys = M.shuffle_keys(5, np.array([day]), np.arange(6))[0, rep]
            order = sorted(have["place"], key=lambda p: keys[p])
            gross.append(1e4 * sum(g.set_index("place")["w"][p][0] * r for p, r in zip(order, have["ret"])))
            paid.append(sum(p[0] for p in g["paid"]))
        x, k = np.array(gross), np.array(paid)
        best = -x - k if (-x - k).mean() > (x - k).mean() else x - k
        assert np.isclose(only["max_t"][rep], newey_west(best, 3))


def test_drawdown_blocks_equal_one_scan(spark):
    dice = np.random.default_rng(1)
    rows = [(k, i, float(dice.normal(0.002, 0.03))) for k, n in (("a", 400), ("b", 60), ("c", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id bigint, x double")
    run = lambda target: {r["k"]: r["prob_dd"] for r in M.prob_drawdown(df, "k", "id", "x", 0.3, 25, 4, target).collect()}
    whole = run(10_000)
    assert run(7) == whole == run(50) and whole["c"] == 0.0 and 0 < whole["b"] <= 1


@pytest.mark.parametrize("seed", range(6))
def test_non_negative_ridge(seed):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(200, 3)) @ dice.normal(size=(3, 3))
    y = x @ dice.normal(size=3) + dice.normal(size=200)
    z = np.column_stack([x, y])
    m = M.centred(200, z.sum(axis=0), (z.T @ z)[np.triu_indices(4)])
    b = M.non_negative_ridge(m, 0.5)
    grad = m[:3, :3] @ b + 0.5 * b - m[:3, 3]  # optimal: no slope where b > 0, none downwards where b = 0
    assert (b >= 0).all() and np.allclose(grad[b > 0], 0, atol=1e-6) and (grad[b == 0] >= -1e-9).all()
    assert np.isclose(M.fit_of(m, b, 200), 1 - np.var(y - x @ b) / (np.var(y) + 1e-9))
