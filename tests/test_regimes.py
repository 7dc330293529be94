"""Crosses, cadences, folds, votes and weight checks on hand-made rows; depth of launch books."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import micro as M
from tidemark.operators import regimes as G
from tidemark.operators.blocks import sequence


def test_rows_since_a_cross(spark):
    dice = np.random.default_rng(2)
    x = dice.normal(0, 1, 300).cumsum() + 2.0
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t bigint, spread double").repartition(3)
    got = {r["t"]: (r["days_since_golden_cross"], r["gc_fresh"]) for r in G.since_cross(df, ["k"], ["t"], "spread", 40, fresh=5).collect()}
    last = None
    for i, v in enumerate(x):
        if i and x[i - 1] <= 0 < v:
            last = i
        days = i - last if last is not None and v > 0 else None
        assert got[i] == (float(days or 0), 1.0 if days is not None and days <= 5 else 0.0)


def test_cadences_share_their_border_rows(spark):
    t = [0, 8, 16, 24, 28, 32, 36, 44]
    df = spark.createDataFrame([("a", x) for x in t] + [("one", 5)], "k string, t bigint")
    got = sorted(tuple(r) for r in G.cadence_regimes(df, ["k"], "t", 1, 10).select("k", "start", "end", "cadence", "n").collect())
    assert got == [("a", 0, 24, 8, 4), ("a", 24, 36, 4, 4), ("a", 36, 44, 8, 2)]


def test_month_folds(spark):
    days = [dt.datetime(2022, 1, 1) + dt.timedelta(days=i, hours=20) for i in range(900)]
    d = G.month_folds(spark.createDataFrame([(x,) for x in days], "ts timestamp"), "ts", fit_months=3, calib_days=30, embargo_hours=8)
    rows = [(r["ts"], r["role"]) for r in d.where("test_month = '2023-03'").collect()]
    start = dt.datetime(2023, 3, 1)
    calib, edge = start - dt.timedelta(days=30), start - dt.timedelta(hours=8)
    middle = calib + (edge - calib) / 2
    for ts in days:
        want = "test" if start <= ts < dt.datetime(2023, 4, 1) else "fit" if dt.datetime(2022, 10, 30) <= ts < calib else "calib_fit" if calib <= ts < middle else "calib_select" if middle <= ts < edge else None
        assert [r for t, r in rows if t == ts] == ([want] if want else [])


def test_votes_need_their_share(spark):
    df = spark.createDataFrame([("a", i, i < 20, i >= 12) for i in range(40)], "k string, t bigint, bear boolean, bull boolean")
    s = sequence(df, ["k"], ["t"], back=24)
    got = {r["t"]: r["v"] for r in s.add({"v": G.majority_vote(s, F.col("bear"), F.col("bull"))}).result().collect()}
    assert got[5] == "NEUTRAL" and got[12] == got[20] == "BEAR" and got[39] == "BULL"


def test_weight_violations(spark):
    rows = [(1, 0.5, 1.0, -0.5, 0.0), (1, -0.5, 0.0, -0.5, 0.0), (2, 1.5, 1.0, 0.0, -1.2), (2, -1.0, 0.0, 0.0, -1.2)]
    df = spark.createDataFrame(rows, "day bigint, w double, beta double, hedge double, ret double")
    r = G.weight_violations(df, "day", "w", "beta", "hedge", "ret", 0.6).first()
    assert tuple(r) == (2, 1, 1, 1, 1, 1)


def test_launch_depth_never_interpolates_depth(spark):
    side = [(20, 400.0), (100, 900.0), (200, 5000.0)]
    df = spark.createDataFrame([(side, [(100, 2000.0)], True, None, 12.0), (side, [(20, 6000.0), (100, 7000.0)], True, None, 12.0), (None, side, False, "one side empty", None), (None, None, False, None, None)],
                               "bids array<struct<bps: int, cum: double>>, asks array<struct<bps: int, cum: double>>, ok boolean, error string, spread double")
    d = df.select("ok", "error", "spread", *[v.alias(k) for k, v in M.launch_depth("bids", "asks", F.col("ok")).items()])
    status, score = M.capacity_status("ok", "error", "resolution_bps", "bid_native_20", "ask_native_20", "bid_native_100", "ask_native_100", "spread")
    a, b, c, e = d.withColumns({"status": status, "score": score}).collect()
    assert a["bid_depth_10"] is None and a["bid_depth_50"] == 400.0 and a["bid_depth_50_is_bound"] and a["ask_depth_50"] is None
    assert a["sell_slippage_500"] == 20 + 80 * 100 / 500 and a["sell_slippage_500_bound"] == 100 and a["buy_slippage_1000"] == 50.0
    assert b["imbalance_25"] == (400 - 6000) / 6400 and b["status"] == "DEPTH_TOO_THIN" and a["resolution_bps"] == 20
    assert (c["status"], e["status"]) == ("BAD_BOOK", "NO_DEPTH") and c["score"] == e["score"] == 0.0
