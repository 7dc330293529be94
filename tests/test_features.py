"""Feature columns over several horizons and bar sequences against plain pandas."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import features as X


@pytest.fixture(scope="module")
def candles():
    rng = np.random.default_rng(9)
    n = 900
    c = 100 * np.exp(rng.normal(0, 0.01, n).cumsum())
    o = np.where(rng.random(n) < 0.15, c, c * (1 + rng.normal(0, 0.004, n)))
    return pd.DataFrame({"k": "a", "t": np.arange(n) * 60, "open": o, "high": np.maximum(o, c) * 1.002, "low": np.minimum(o, c) * 0.998, "close": c, "volume": rng.integers(1, 50, n).astype(float)})


def test_long_horizon_columns(spark, candles):
    got = X.long_horizon_table(spark.createDataFrame(candles), ["k"], "t", (10, 20, 50, 200)).toPandas().sort_values("t").reset_index(drop=True)
    c = candles["close"]
    sma = lambda n: c.rolling(n, min_periods=n // 3).mean()
    r = np.log(c / c.shift(1))
    sd = lambda n: r.rolling(n, min_periods=n // 3).std()
    obv = (np.sign(c.diff()).fillna(0) * candles["volume"]).cumsum()
    want = {"volatility_ratio_10_200": (sd(10) / (sd(200) + 1e-12)).fillna(0), "ma_spread_50_200": ((sma(50) - sma(200)) / sma(200)).fillna(0), "moving_average_crossover_20_200": (sma(20) > sma(200)).astype(float),
            "fast_ema_cross": (c.ewm(span=20, adjust=False).mean() > c.ewm(span=50, adjust=False).mean()).astype(float), "weekly_trend": (c / c.shift(168) - 1).fillna(0), "monthly_trend": (c / c.shift(720) - 1).fillna(0),
            "long_term_volume_trend": obv.rolling(200, min_periods=66).apply(lambda y: np.polyfit(np.arange(len(y)), y, 1)[0], raw=True)}
    for k, v in want.items():
        np.testing.assert_allclose(got[k].astype(float), v, rtol=1e-6, atol=1e-8, err_msg=k)


def test_candle_sequences(spark, candles):
    got = X.candle_sequences(spark.createDataFrame(candles), ["k"], "t", 6000).toPandas().sort_values("t").reset_index(drop=True)
    g = np.sign(candles["close"] - candles["open"])

    def entropy(x):
        if len(x) < 2:
            return 0.0
        p = np.histogram(x, bins=min(10, max(2, len(x) // 2)))[0].astype(float)
        p = p[p > 0] / p.sum()
        return float(-np.sum(p * np.log(p + 1e-12)) / np.log(len(p) + 1e-12))

    for n in X.SEQUENCES:
        np.testing.assert_allclose(got[f"sequence_entropy_{n}"], g.rolling(n, min_periods=1).apply(entropy, raw=True), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got[f"last_candle_directions_sum_{n}"], g.rolling(n, min_periods=1).sum())
    run, runs = 0, []
    for up in candles["close"] > candles["close"].shift(1):
        run = run + 1 if up else 0
        runs.append(run)
    assert got["consecutive_higher_closes"].tolist() == runs
    assert list(got["seq_last_candle_directions_5"].iloc[1]) == [0.0, 0.0, 0.0, *g.iloc[:2]]
