"""Higher timeframes on hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import horizons as H
from tidemark.operators.blocks import HOURS
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, bars

WIDTHS = {"4h": 4 * HOUR_US, "1d": DAY_US}
_O = "(PARTITION BY symbol ORDER BY bar)"
_R = lambda n: f"(PARTITION BY symbol ORDER BY bar ROWS {n - 1} PRECEDING)"
_EWM = lambda n: f"list_reduce(cl, lambda a, b: a + (b - a) * 2 / {n + 1}.0)"
_WILD = lambda x: f"list_reduce({x}, lambda a, b: a + (b - a) / 14.0)"
_SD = lambda a, b: f"coalesce(({a}) / (({b}) + 1e-12), 0)"
_5 = lambda f, x: f"CASE WHEN count({x}) OVER {_R(20)} >= 5 THEN {f} OVER {_R(20)} END"


def _higher(name: str, width: int) -> str:
    return f"""h{name} AS (SELECT symbol, bar - bar % {width} AS bar, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2),
i{name} AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS cl, close - lag(close) OVER {_O} AS d, ln(close / lag(close) OVER {_O}) AS lr, (high + low + close) / 3 * volume AS pv FROM h{name}),
j{name} AS (SELECT *, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER w AS up, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER w AS dn FROM i{name} WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING)),
k{name} AS (SELECT symbol, bar, sign(round({_EWM(21)} - {_EWM(50)}, 12)) AS trend, 100 - 100 / (1 + CASE WHEN d IS NULL AND cl[2] IS NULL THEN 0 ELSE coalesce({_WILD('up')} / ({_WILD('dn')} + 1e-12), 0) END) AS rsi, {_5('stddev_samp(lr)', 'lr')} AS volatility, {_5('min(low)', 'low')} AS support, {_5('max(high)', 'high')} AS resistance,
 {_SD(f'sum(pv) OVER {_R(20)}', f'sum(volume) OVER {_R(20)}')} AS vwap, {_SD(f"close - ({_5('avg(close)', 'close')})", _5('avg(close)', 'close'))} AS distance_sma FROM j{name}),
l{name} AS (SELECT symbol, bar, {', '.join(f'lag({p}) OVER {_O} AS {p}' for p in H.PARTS)} FROM k{name})"""


_N = len(WIDTHS)
_TF = f"""{BARS}, {', '.join(_higher(n, w) for n, w in WIDTHS.items())},
a AS (SELECT b.symbol, b.bar, b.close, {', '.join(f'l{n}.{p} AS higher_timeframe_{p}_{n}' for n in WIDTHS for p in H.PARTS)} FROM bars b {' '.join(f'ASOF LEFT JOIN l{n} ON l{n}.symbol = b.symbol AND b.bar >= l{n}.bar' for n in WIDTHS)}),
c AS (SELECT *, nullif(sign(close - lag(close) OVER {_O}), 0) AS move, close / lag(close, 3) OVER {_O} - 1 AS lower_timeframe_momentum, CASE WHEN count(close) OVER q >= 5 THEN max(close) OVER q END AS top FROM a WINDOW q AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, {' + '.join(f'CASE WHEN higher_timeframe_trend_{n} = move THEN 1 ELSE 0 END' for n in WIDTHS)} AS same, {' + '.join(f'CASE WHEN higher_timeframe_trend_{n} IS NOT NULL THEN 1 ELSE 0 END' for n in WIDTHS)} AS known, {' + '.join(f'coalesce(higher_timeframe_trend_{n}, 0)' for n in WIDTHS)} AS total FROM c)"""
_COLS = [f"higher_timeframe_{p}_{n}" for n in WIDTHS for p in H.PARTS]
_OWN = ["alignment_score", "conflict_score", "lower_timeframe_momentum", "long_term_trend_short_term_pullback", "short_term_breakout_in_long_term_trend"]


@query("higher_timeframes", "D6", f"""WITH {_TF} SELECT symbol, bar, {', '.join(_COLS)}, {_SD('same', 'known')} AS alignment_score, CASE WHEN known > 0 THEN {_SD(f'{_N} - same', 'known')} ELSE 0 END AS conflict_score, lower_timeframe_momentum, CASE WHEN known > 0 AND total > 0 AND lower_timeframe_momentum < 0 THEN 1.0 ELSE 0 END AS long_term_trend_short_term_pullback,
 CASE WHEN known > 0 AND total > 0 AND close > top THEN 1.0 ELSE 0 END AS short_term_breakout_in_long_term_trend FROM s""", " ".join([*_COLS, *_OWN]), digits=4)
def higher_timeframes(spark, folder):
    b = bars(spark, folder).select("symbol", "bar", "open", "high", "low", "close", "volume")
    return H.higher_timeframes(b, ["symbol"], "bar", WIDTHS, HOURS).select("symbol", "bar", *_COLS, *[F.col(x) for x in _OWN])
