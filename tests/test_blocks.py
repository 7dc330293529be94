"""Blocked operators give the same rows as a plain scan, whatever the block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import recurrence as K
from tidemark.operators import rolling as R
from tidemark.operators.blocks import RN, number_rows, running_total, sequence
from tidemark.operators.crosssection import exact_quantiles, global_rank
from tidemark.operators.events import cooldown, greedy_anchors, other_names_within, session_ids, trailing_counts
from tidemark.operators.stats import bh_qvalues


@pytest.fixture(scope="module")
def walk():
    """One key holds most rows, with bursts on few clocks."""
    rng = np.random.default_rng(3)
    rows = []
    for k, n in (("hot", 900), ("mid", 120), ("one", 1)):
        t = np.cumsum(rng.integers(0, 40, n) * (rng.random(n) < 0.7)) + rng.integers(0, 5)
        rows += [(k, int(a), i, float(x)) for i, (a, x) in enumerate(zip(t, rng.normal(size=n).cumsum()))]
    return pd.DataFrame(rows, columns=["k", "t", "i", "x"])


@pytest.fixture(scope="module")
def df(spark, walk):
    return spark.createDataFrame(walk).repartition(5).cache()


def same(a, b, keys):
    a = a.sort_values(keys).reset_index(drop=True)
    b = b.sort_values(keys).reset_index(drop=True)[a.columns]
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_number_rows_and_running_total(df, walk):
    got = number_rows(df, ["k"], ["t", "i"], width=50, target=20).toPandas()
    want = walk.sort_values(["k", "t", "i"])
    want["_rn"] = want.groupby("k").cumcount()
    same(want[["k", "i", "_rn"]], got[["k", "i", RN]], ["k", "i"])
    got = running_total(df, ["k"], ["t", "i"], {"s": F.col("x")}, width=100, target=16).toPandas()
    want["s"] = want.groupby("k")["x"].cumsum()
    same(want[["k", "i", "s"]], got[["k", "i", "s"]], ["k", "i"])


@pytest.mark.parametrize("size", [37, 10_000])
def test_row_frames_are_exact_across_blocks(df, walk, size):
    s = sequence(df, ["k"], ["t", "i"], back=12, ahead=3, size=size)
    assert s.single == (size == 10_000)
    s = s.add({"z": R.prior_z(s, "x", 10, 4), "f": F.lead("x", 3).over(s.by()), "m": R.mean(s, "x", 5, 2)})
    got = s.result("k", "i", "z", "f", "m").toPandas()
    w = walk.sort_values(["k", "t", "i"])
    g = w.groupby("k")["x"]
    p = g.shift(1)
    mean = p.groupby(w["k"]).rolling(10, min_periods=4).mean().reset_index(0, drop=True)
    sd = p.groupby(w["k"]).rolling(10, min_periods=4).std().reset_index(0, drop=True)
    w["z"], w["f"] = (w["x"] - mean) / sd, g.shift(-3)
    w["m"] = g.rolling(5, min_periods=2).mean().reset_index(0, drop=True)
    same(w[["k", "i", "z", "f", "m"]], got, ["k", "i"])


@pytest.mark.parametrize("direction,exact,tol", [("backward", True, None), ("backward", False, 30), ("forward", True, 25), ("forward", False, None)])
def test_asof_matches_pandas(spark, df, walk, direction, exact, tol):
    rng = np.random.default_rng(5)
    r = pd.DataFrame({"k": rng.choice(["hot", "mid"], 300, p=[0.8, 0.2]), "u": rng.integers(0, 12_000, 300), "v": np.arange(300.0)}).drop_duplicates(["k", "u"])
    got = A.asof_join(df, spark.createDataFrame(r), by=["k"], left_clock="t", right_clock="u", cols=["v"], prefix="r_", direction=direction, exact=exact, tolerance=tol, width=64, target=25).toPandas()
    want = pd.merge_asof(walk.sort_values("t"), r.sort_values("u"), left_on="t", right_on="u", by="k", direction=direction, allow_exact_matches=exact, tolerance=tol)
    same(want[["k", "i", "v"]].rename(columns={"v": "r_v"}), got[["k", "i", "r_v"]], ["k", "i"])


def test_window_and_interval_sums(spark, df, walk):
    got = A.window_sums(df.select("k", "i", "t"), df.select("k", F.col("t").alias("u"), F.lit(1).alias("one")), by=["k"], left_clock="t", right_clock="u", lo=-30, hi=0, lo_open=True, values={"n": F.col("one")}, width=64).toPandas()
    want = walk.copy()
    want["n"] = [int(((walk.k == k) & (walk.t > t - 30) & (walk.t <= t)).sum()) for k, t in zip(walk.k, walk.t)]
    same(want[["k", "i", "n"]], got[["k", "i", "n"]], ["k", "i"])
    got = A.interval_sums(df.select("k", "i", "t"), df.select("k", F.col("t").alias("u"), "x"), by=["k"], lo=F.col("t"), hi=F.col("t") + F.col("i") % 50, right_clock="u", values={"s": F.col("x")}, width=64).toPandas()
    want["s"] = [walk.x[(walk.k == k) & (walk.t > t) & (walk.t <= t + i % 50)].sum() for k, t, i in zip(walk.k, walk.t, walk.i)]
    same(want[["k", "i", "s"]], got[["k", "i", "s"]], ["k", "i"])


@pytest.mark.parametrize("size", [25, 10_000])
@pytest.mark.parametrize("strict", [False, True])
def test_greedy_cooldown(df, walk, size, strict):
    got = greedy_anchors(df, ["k"], "t", 90, strict=strict, size=size).toPandas()
    want = walk.sort_values(["k", "t", "i"])
    anchors = []
    for _, g in want.groupby("k"):
        last = None
        for t in g.t:
            if last is None or (t - last > 90 if strict else t - last >= 90):
                last = t
            anchors.append(last)
    want["anchor"] = anchors
    same(want[["k", "i", "anchor"]], got[["k", "i", "anchor"]], ["k", "i"])
    assert cooldown(df.select("k", "t").distinct(), ["k"], "t", 90, strict=strict, size=size).count() == want.groupby("k")["anchor"].nunique().sum()


def test_sessions_counts_and_densities(df, walk):
    got = session_ids(df, ["k"], "t", ["t", "i"], 35, "ep", width=200).toPandas()
    w = walk.sort_values(["k", "t", "i"])
    w["ep"] = (w.groupby("k")["t"].diff() > 35).groupby(w["k"]).cumsum()
    same(w[["k", "i", "ep"]], got[["k", "i", "ep"]], ["k", "i"])
    got = trailing_counts(df.select("k", "i", "t"), ["k"], "t", 60, "n").toPandas()
    w["n"] = [int(((walk.k == k) & (walk.t >= t - 60) & (walk.t < t)).sum()) for k, t in zip(w.k, w.t)]
    same(w[["k", "i", "n"]], got[["k", "i", "n"]], ["k", "i"])
    got = other_names_within(df.select("k", "i", "t"), "k", "t", 100, "d", width=300).toPandas()
    w["d"] = [walk.k[(walk.k != k) & (walk.t > t - 100) & (walk.t < t)].nunique() for k, t in zip(w.k, w.t)]
    same(w[["k", "i", "d"]], got[["k", "i", "d"]], ["k", "i"])


def test_smoothers_forget(df, walk):
    """Blocks with warm-up rows agree with one scan of the whole key."""
    w = walk.sort_values(["k", "t", "i"])
    outs = {"e": (K.ema(3), ["x"]), "d": (K.dema(3), ["x"]), "r": (K.rsi(3), ["x"])}
    got = K.smooth(df, ["k"], ["t", "i"], outs, back=K.warmup(6, 2), size=K.warmup(6, 2)).toPandas()
    for name, (fn, _) in outs.items():
        w[name] = np.concatenate([np.asarray(fn(g.x)) for _, g in w.groupby("k")])
    same(w[["k", "i", "e", "d", "r"]], got[["k", "i", "e", "d", "r"]], ["k", "i"])


def test_runs_and_states(df, walk):
    w = walk.sort_values(["k", "t", "i"])
    got = K.add_run_lengths(df, ["k"], ["t", "i"], {"up": F.col("x") > 0}, 100).toPandas()
    up, hys, con = [], [], []
    for _, g in w.groupby("k"):
        n, state, target, run, held = 0, 0.0, None, 0, "lo"
        for x in g.x:
            n = n + 1 if x > 0 else 0
            up.append(n)
            if abs(x) < 1:
                state = 0.0
            elif abs(x) >= 3 and state == 0.0:
                state = float(np.sign(x))
            hys.append(state)
            t = "hi" if x > 0 else "lo"
            run = run + 1 if t == target else 1
            target = t
            held = t if run >= 3 else held
            con.append(held)
    w["up"], w["h"], w["c"] = up, hys, con
    same(w[["k", "i", "up"]], got[["k", "i", "up"]], ["k", "i"])
    got = K.hysteresis(df, ["k"], ["t", "i"], "x", "h", 3.0, 1.0, 100).toPandas()
    same(w[["k", "i", "h"]], got[["k", "i", "h"]], ["k", "i"])
    d = df.withColumn("tg", F.when(F.col("x") > 0, "hi").otherwise("lo"))
    # The state lookup needs one row per clock.
    one = d.groupBy("k", "t").agg(F.max_by("tg", "i").alias("tg"))
    got = K.confirmed_state(one, ["k"], ["t"], "tg", "c", 3, 100, "lo").toPandas()
    want = []
    for k, g in w.groupby(["k", "t"]).tail(1).groupby("k"):
        target, run, held = None, 0, "lo"
        for t, x in zip(g.t, g.x):
            tg = "hi" if x > 0 else "lo"
            run = run + 1 if tg == target else 1
            target, held = tg, tg if run >= 3 else held
            want.append((k, t, held))
    same(pd.DataFrame(want, columns=["k", "t", "c"]), got[["k", "t", "c"]], ["k", "t"])


def test_ranks_quantiles_and_qvalues_over_cells(spark):
    rng = np.random.default_rng(9)
    v = np.where(rng.random(3000) < 0.35, 1.25, rng.normal(size=3000).round(2))  # a third of all rows share a value
    p = pd.DataFrame({"i": np.arange(3000), "g": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), "v": v})
    d = spark.createDataFrame(p)
    got = global_rank(d, ["g"], "v", "r", rows=40).toPandas()
    p["r"] = p.groupby("g")["v"].rank()
    same(p[["i", "r"]], got[["i", "r"]], ["i"])
    got = exact_quantiles(d, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.933}, rows=40).toPandas().set_index("g")
    for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.933)):
        assert np.allclose(got[name], p.groupby("g")["v"].quantile(q)[got.index])
    p["p"] = rng.random(3000).round(3)
    got = bh_qvalues(spark.createDataFrame(p), "p", "q", rows=30).toPandas()
    o = np.argsort(p["p"].to_numpy(), kind="stable")
    q = np.minimum.accumulate((p["p"].to_numpy()[o] * 3000 / np.arange(1, 3001))[::-1])[::-1].clip(max=1)
    want = pd.DataFrame({"i": p["i"].to_numpy()[o], "q": q})
    want["q"] = want["q"].groupby(p["p"].to_numpy()[o]).transform("min")
    same(want, got[["i", "q"]], ["i"])


def test_mutual_match_brute_force(spark):
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"s": "x", "at": np.sort(rng.choice(4000, 120, replace=False)), "a": np.arange(120)})
    b = pd.DataFrame({"s": "x", "bt": np.sort(rng.choice(4000, 120, replace=False)), "b": np.arange(120)})
    got = A.mutual_matches(spark.createDataFrame(a), spark.createDataFrame(b), by=["s"], a_clock="at", b_clock="bt", a_id="a", b_id="b", tolerance=12).toPandas().set_index("a_id")
    near = np.abs(a["at"].to_numpy()[:, None] - b["bt"].to_numpy()) <= 12
    for i in range(120):
        hit = np.flatnonzero(near[i])
        if len(hit) == 1 and near[:, hit[0]].sum() == 1:
            assert got.loc[i, "status"] == "matched" and got.loc[i, "b_id"] == hit[0]
        else:
            assert got.loc[i, "status"] == ("unmatched" if len(hit) == 0 else "ambiguous")


def test_no_future_in_the_past(spark, walk):
    """Changing later rows leaves earlier features as they were."""
    cut = 400
    cols = {}
    for name, pdf in (("a", walk), ("b", walk.assign(x=walk.x.where(walk.i < cut, walk.x * -3 + 1)))):
        s = sequence(spark.createDataFrame(pdf), ["k"], ["t", "i"], back=40)
        s = s.add({"z": R.prior_z(s, "x", 20, 5), "w": R.wma(s, "x", 9), "p": R.prior_rank_share(s, "x", 20, 5), "dd": R.max_drawdown(s, F.abs("x") + 1, 10)})
        cols[name] = s.result("k", "i", "z", "w", "p", "dd").where(F.col("i") < cut).toPandas()
    same(cols["a"], cols["b"], ["k", "i"])
