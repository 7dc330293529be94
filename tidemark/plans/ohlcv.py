"""OHLCV feature family queries over the hourly bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import rolling as R
from tidemark.operators.blocks import HOURS, sequence
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, bars

N = 10
_O = "(PARTITION BY symbol ORDER BY bar)"
_R = lambda k: f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
_SD = lambda a, b: f"coalesce(({a}) / (({b}) + 1e-12), 0)"
_BASE = f"""{BARS}, f0 AS (SELECT symbol, bar, open AS o, high AS h, low AS l, close AS c, volume AS v, lag(close) OVER {_O} AS pc, lag(high) OVER {_O} AS ph, lag(low) OVER {_O} AS pl, lag(open) OVER {_O} AS po, row_number() OVER {_O} AS i FROM bars),
f AS (SELECT *, c / pc - 1 AS ret, ln({_SD('c', 'pc')}) AS lr, c - pc AS d, (h + l + c) / 3 AS tp, h - l AS rg, abs(c - o) AS body, h - greatest(o, c) AS uw, least(o, c) - l AS lw, c * v AS dv, greatest(h - l, coalesce(abs(h - pc), 0), coalesce(abs(l - pc), 0)) AS tr FROM (SELECT * REPLACE (CASE WHEN pc IS NULL THEN NULL ELSE pc END AS pc) FROM f0)),
f1 AS (SELECT * REPLACE (CASE WHEN pc IS NULL THEN NULL ELSE lr END AS lr) FROM f)"""
_G = lambda agg, x, n=N: f"(CASE WHEN count({x}) OVER {_R(n)} >= {R.min_periods(n)} THEN {agg} OVER {_R(n)} END)"


def prepared(spark, folder, recursive=False, horizons=(N,), complexity=()):
    return X.prepare(bars(spark, folder), ["symbol"], "bar", horizons, recursive, complexity, HOURS)


def out(s, *cols):
    return s.result("symbol", "bar", *cols)


@query("base_prices", "H2 H30", f"WITH {_BASE} SELECT symbol, bar, tp AS typical, (h + l) / 2 AS median_price, (h + l + 2 * c) / 4 AS weighted_close, (o + h + l + c) / 4 AS ohlc_average, dv AS dollar_volume, tr AS true_range FROM f1", "typical median_price weighted_close ohlc_average dollar_volume true_range")
def base_prices(spark, folder):
    return out(prepared(spark, folder), "typical", "median_price", "weighted_close", "ohlc_average", "dollar_volume", "true_range")


@query("single_bar_features", "H3", f"""WITH {_BASE} SELECT symbol, bar, {_SD('o', 'pc')} - 1 AS gap, {_SD('body', 'rg')} AS body_ratio, CASE WHEN {_SD('body', 'rg')} < 0.1 THEN 1.0 ELSE 0 END AS doji, CASE WHEN lw > 2 * body AND uw < body THEN 1.0 ELSE 0 END AS hammer,
 CASE WHEN h <= ph AND l >= pl THEN 1.0 ELSE 0 END AS inside, CASE WHEN h >= ph AND l <= pl THEN 1.0 ELSE 0 END AS outside, 2 * {_SD('c - l', 'rg')} - 1 AS pressure,
 CASE WHEN c > o AND NOT pc > po AND c >= po AND o <= pc THEN 1.0 ELSE 0 END - CASE WHEN NOT c > o AND pc > po AND o >= pc AND c <= po THEN 1.0 ELSE 0 END AS engulfing FROM f1""", "gap body_ratio doji hammer inside outside pressure engulfing")
def single_bar_features(spark, folder):
    return out(X.single_bar(prepared(spark, folder)), "gap", "body_ratio", "doji", "hammer", "inside", "outside", "pressure", "engulfing")


@query("return_family", "H4 H43", f"""WITH {_BASE}, y AS (SELECT *, lag(c, {N}) OVER {_O} AS p FROM f1) SELECT symbol, bar, c / p - 1 AS return_10, {_SD('c - p', 'p')} AS roc_10, exp(sum(coalesce(lr, 0)) OVER {_R(N)}) - 1 AS cumulative_10, {_SD('c', _G('avg(c)', 'c'))} - 1 AS norm_mean_10,
 {_SD('c - ' + _G('avg(c)', 'c'), _G('stddev_samp(c)', 'c'))} AS norm_vol_10, {_SD('c - ' + _G('min(l)', 'l'), _G('max(h)', 'h') + ' - ' + _G('min(l)', 'l'))} AS minmax_10, {_SD('c - ' + _G('median(c)', 'c'), _G('quantile_cont(c, 0.9)', 'c') + ' - ' + _G('quantile_cont(c, 0.1)', 'c'))} AS robust_10 FROM y""",
       "return_10 roc_10 cumulative_10 norm_mean_10 norm_vol_10 minmax_10 robust_10", digits=4)
def return_family(spark, folder):
    return out(X.returns(prepared(spark, folder), N), "return_10", "roc_10", "cumulative_10", "norm_mean_10", "norm_vol_10", "minmax_10", "robust_10")


@query("volatility_family", "H5 H49", f"""WITH {_BASE}, y AS (SELECT *, power(ln({_SD('h', 'l')}), 2) AS hl2, power(ln({_SD('c', 'o')}), 2) AS co2, ln({_SD('h', 'c')}) * ln({_SD('h', 'o')}) + ln({_SD('l', 'c')}) * ln({_SD('l', 'o')}) AS rs FROM f1)
SELECT symbol, bar, {_G('stddev_samp(lr)', 'lr')} AS rv_10, sqrt({_SD(_G('avg(hl2)', 'hl2'), repr(4 * math.log(2)))}) AS parkinson_10, sqrt(greatest({_G(f'avg(0.5 * hl2 - {2 * math.log(2) - 1!r} * co2)', 'hl2')}, 0) + CASE WHEN {_G('avg(hl2)', 'hl2')} IS NULL THEN NULL ELSE 0 END) AS garman_klass_10,
 sqrt(greatest({_G('avg(rs)', 'rs')}, 0) + CASE WHEN {_G('avg(rs)', 'rs')} IS NULL THEN NULL ELSE 0 END) AS rogers_10, {_SD('rg', _G('avg(rg)', 'rg'))} AS range_expansion_10 FROM y""", "rv_10 parkinson_10 garman_klass_10 rogers_10 range_expansion_10")
def volatility_family(spark, folder):
    return out(X.volatility(prepared(spark, folder), N), "rv_10", "parkinson_10", "garman_klass_10", "rogers_10", "range_expansion_10")


@query("volume_family", "H9", f"""WITH {_BASE}, y AS (SELECT *, {_SD('(c - l) - (h - c)', 'h - l')} * v AS fl, CASE WHEN tp > lag(tp) OVER {_O} THEN tp * v ELSE 0 END AS mu, CASE WHEN tp < lag(tp) OVER {_O} THEN tp * v ELSE 0 END AS md FROM f1)
SELECT symbol, bar, {_SD('v', _G('avg(v)', 'v'))} AS volume_ratio_10, {_SD('v - ' + _G('avg(v)', 'v'), _G('stddev_samp(v)', 'v'))} AS volume_z_10, {_SD(_G('sum(fl)', 'fl'), _G('sum(v)', 'v'))} AS cmf_10, 100 - 100 / (1 + {_SD(f'sum(mu) OVER {_R(N)}', f'sum(md) OVER {_R(N)}')}) AS mfi_10,
 (c - lag(c, {N}) OVER {_O}) * v AS force_10, {_SD(f'sum(CASE WHEN c >= o THEN v ELSE 0 END) OVER {_R(N)} - sum(CASE WHEN c >= o THEN 0 ELSE v END) OVER {_R(N)}', f'sum(v) OVER {_R(N)}')} AS volume_imbalance_10 FROM y""", "volume_ratio_10 volume_z_10 cmf_10 mfi_10 force_10 volume_imbalance_10", digits=4)
def volume_family(spark, folder):
    return out(X.volume(prepared(spark, folder), N), "volume_ratio_10", "volume_z_10", "cmf_10", "mfi_10", "force_10", "volume_imbalance_10")


@query("volume_accumulators", "H9", f"""WITH {_BASE}, y AS (SELECT *, lag(v) OVER {_O} AS pv FROM f1), z AS (SELECT symbol, bar, coalesce(sign(d), 0) * v AS ob, {_SD('(c - l) - (h - c)', 'h - l')} * v AS fl, coalesce(ret, 0) * v AS vp,
 CASE WHEN v < pv THEN ln(1 + ret) ELSE 0 END AS dn, CASE WHEN v > pv THEN ln(1 + ret) ELSE 0 END AS up FROM y) SELECT symbol, bar, sum(ob) OVER w AS obv, sum(fl) OVER w AS accumulation, sum(vp) OVER w AS volume_price_trend, sum(dn) OVER w AS negative_volume_log, sum(up) OVER w AS positive_volume_log
 FROM z WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING)""", "obv accumulation volume_price_trend negative_volume_log positive_volume_log", digits=4)
def volume_accumulators(spark, folder):
    s = sequence(bars(spark, folder), ["symbol"], ["bar"], back=1, bound=HOURS)
    # the indices themselves span many powers of ten on these bars, so their logs are returned
    return X.accumulated_volume(s).drop("negative_volume_index", "positive_volume_index")


@query("liquidity_family", "H10 H22 H41", f"""WITH {_BASE} SELECT symbol, bar, {_SD(f'sum(tp * v) OVER {_R(N)}', f'sum(v) OVER {_R(N)}')} AS vwap_10, {_SD(f'sum(ret * v) OVER {_R(N)}', f'sum(v) OVER {_R(N)}')} AS vw_return_10, ln(1 + {_SD(f'sum(v) OVER {_R(N)}', f'sum(rg) OVER {_R(N)}')}) AS liquidity_10,
 {_SD('v', _G('avg(v)', 'v'))} * least(greatest(1 - {_SD('body', 'rg')}, 0), 1) AS absorption_10, rg FROM f1""", "vwap_10 vw_return_10 liquidity_10 absorption_10 rg", digits=4)
def liquidity_family(spark, folder):
    s = X.liquidity(prepared(spark, folder), N)
    return s.result("symbol", "bar", "vwap_10", "vw_return_10", F.ln(1 + F.col("liquidity_10")).alias("liquidity_10"), "absorption_10", F.col("range").alias("rg"))


@query("levels_and_structure", "H11 H12 H20 H21", f"""WITH {_BASE}, y AS (SELECT *, {_G('max(h)', 'h')} AS hi, {_G('min(l)', 'l')} AS lo, {_SD('v', _G('avg(v)', 'v'))} AS vr FROM f1), z AS (SELECT *, lag(hi) OVER {_O} AS hi1, lag(lo) OVER {_O} AS lo1 FROM y)
SELECT symbol, bar, {_SD('hi - c', 'c')} AS distance_high_10, CASE WHEN c > hi1 THEN 1.0 ELSE 0 END AS breakout_10, (ph + pl + pc) / 3 AS pivot_10, hi - 0.618 * (hi - lo) AS fib_618_10, CASE WHEN h = hi AND ph < h THEN 1.0 ELSE 0 END AS swing_high_10, sum(CASE WHEN uw + lw > 2 * body THEN 1.0 ELSE 0 END) OVER {_R(N)} AS rejections_10,
 CASE WHEN l > lo1 THEN 1.0 ELSE 0 END AS higher_low_10, {_SD('hi - c', 'hi - lo')} AS pullback_depth_10, CASE WHEN c > hi1 AND vr > 1.25 THEN 1.0 ELSE 0 END AS confirmed_breakout_10 FROM z""", "distance_high_10 breakout_10 pivot_10 fib_618_10 swing_high_10 rejections_10 higher_low_10 pullback_depth_10 confirmed_breakout_10", digits=5)
def levels_and_structure(spark, folder):
    s = X.structure(X.levels(X.volume(prepared(spark, folder), N), N), N)
    return out(s, "distance_high_10", "breakout_10", "pivot_10", "fib_618_10", "swing_high_10", "rejections_10", "higher_low_10", "pullback_depth_10", "confirmed_breakout_10")


@query("statistics_family", "H16 H36", f"""WITH {_BASE} SELECT symbol, bar, {_G('avg(lr)', 'lr')} AS mean_10, {_G('median(lr)', 'lr')} AS median_10, {_G('quantile_cont(lr, 0.25)', 'lr')} AS q25_10, {_G('avg(lr)', 'lr')} / nullif({_G('stddev_samp(lr)', 'lr')}, 0) AS sharpe_10, avg(CASE WHEN lr > 0 THEN 1.0 ELSE 0 END) OVER {_R(N)} AS win_rate_10 FROM f1""", "mean_10 median_10 q25_10 sharpe_10 win_rate_10")
def statistics_family(spark, folder):
    return out(X.statistics(prepared(spark, folder), N), "mean_10", "median_10", "q25_10", "sharpe_10", "win_rate_10")


@query("risk_family", "H17 H18 H19", f"""WITH {_BASE} SELECT symbol, bar, coalesce(stddev_samp(CASE WHEN lr < 0 THEN lr END) OVER {_R(N)}, 0) AS downside_10, coalesce(stddev_samp(CASE WHEN lr > 0 THEN lr END) OVER {_R(N)}, 0) AS upside_10, {_SD(_G('quantile_cont(lr, 0.05)', 'lr'), _G('stddev_samp(lr)', 'lr'))} AS tail_10, sum(dv) OVER {_R(N)} AS turnover_10 FROM f1""", "downside_10 upside_10 tail_10 turnover_10", digits=5)
def risk_family(spark, folder):
    return out(X.risk(prepared(spark, folder), N), "downside_10", "upside_10", "tail_10", "turnover_10")


@query("directional_family", "H14", f"""WITH {_BASE}, y AS (SELECT *, list(h) OVER {_R(N)} AS hs, list(l) OVER {_R(N)} AS ls FROM f1) SELECT symbol, bar, 100.0 * (len(hs) - list_position(hs, list_max(hs))) / greatest(len(hs) - 1, 1) AS aroon_up_10, 100.0 * (len(ls) - list_position(ls, list_min(ls))) / greatest(len(ls) - 1, 1) AS aroon_down_10,
 {_SD(f'sum(abs(h - pl)) OVER {_R(N)}', f'sum(tr) OVER {_R(N)}')} AS vortex_plus_10, {_SD(f'abs(c - lag(c, {N}) OVER {_O})', f'sum(abs(d)) OVER {_R(N)}')} AS efficiency_10 FROM y""", "aroon_up_10 aroon_down_10 vortex_plus_10 efficiency_10")
def directional_family(spark, folder):
    return out(X.directional(prepared(spark, folder), N), "aroon_up_10", "aroon_down_10", "vortex_plus_10", "efficiency_10")


@query("momentum_family", "H7", f"""WITH {_BASE}, y AS (SELECT *, {_G('max(h)', 'h')} AS hi, {_G('min(l)', 'l')} AS lo, {_G('avg(tp)', 'tp')} AS tm, list(tp) OVER {_R(N)} AS tl, c - least(l, pc) AS bp, greatest(h, pc) - least(l, pc) AS uo FROM f1), z AS (SELECT *, {_SD('c - lo', 'hi - lo')} AS k FROM y)
SELECT symbol, bar, k AS stoch_k_10, avg(k) OVER {_R(3)} AS stoch_d_10, -100 * {_SD('hi - c', 'hi - lo')} AS williams_10, {_SD('tp - tm', '0.015 * list_avg(list_transform(tl, lambda q: abs(q - tm)))')} AS cci_10, c - lag(c, {N}) OVER {_O} AS momentum_10 FROM z""", "stoch_k_10 stoch_d_10 williams_10 cci_10 momentum_10", digits=4)
def momentum_family(spark, folder):
    return out(X.momentum(prepared(spark, folder, True), N), "stoch_k_10", "stoch_d_10", "williams_10", "cci_10", "momentum_10")


@query("session_features", "H25", f"""WITH {BARS}, y AS (SELECT *, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol, bar // {DAY_US} ORDER BY bar)) SELECT symbol, bar, first_value(open) OVER w AS session_open, max(high) OVER w AS session_high, min(low) OVER w AS session_low, sum(volume) OVER w AS session_volume,
 coalesce(sum((high + low + close) / 3 * volume) OVER w / (sum(volume) OVER w + 1e-12), 0) AS session_vwap, max(CASE WHEN k <= 4 THEN high END) OVER w AS opening_high, close / max(high) OVER w - 1 AS session_drawdown FROM y WINDOW w AS (PARTITION BY symbol, bar // {DAY_US} ORDER BY bar)""", "session_open session_high session_low session_volume session_vwap opening_high session_drawdown")
def session_features(spark, folder):
    d = X.sessions(bars(spark, folder), ["symbol"], "bar", DAY_US)
    return d.select("symbol", "bar", "session_open", "session_high", "session_low", "session_volume", "session_vwap", "opening_high", "session_drawdown")


@query("temporal_features", "H28", f"""WITH {BARS}, y AS (SELECT symbol, bar, hour(make_timestamp(bar)) AS hour, dayofweek(make_timestamp(bar)) AS dow, month(make_timestamp(bar)) AS month FROM bars) SELECT symbol, bar, hour, dow, month, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, CASE WHEN dow IN (0, 6) THEN 1.0 ELSE 0 END AS weekend, 24 - hour AS hours_to_close FROM y""", "hour_sin hour_cos weekend")
def temporal_features(spark, folder):
    cols = X.calendar_columns("bar")
    return bars(spark, folder).select("symbol", "bar", *[cols[k].alias(k) for k in ("hour", "dow", "month", "hour_sin", "hour_cos", "weekend", "hours_to_close")])


@query("donchian_and_breakout", "H46 H47 H48", f"""WITH {_BASE}, y AS (SELECT symbol, bar, c, max(h) OVER {_R(20)} AS hi, min(l) OVER {_R(20)} AS lo, max(h) OVER p AS ph20, min(l) OVER p AS pl20, count(h) OVER p AS n FROM f1 WINDOW p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, bar, least(greatest(2 * (c - lo) / nullif(hi - lo, 0) - 1, -1), 1) AS donchian, CASE WHEN n = 20 THEN CASE WHEN c > ph20 THEN c / ph20 - 1 WHEN c < pl20 THEN c / pl20 - 1 ELSE 0 END END AS breakout FROM y WHERE hi > lo""", "donchian breakout")
def donchian_and_breakout(spark, folder):
    from tidemark.functions.scalars import clip, div
    s = prepared(spark, folder, horizons=(20,))
    hi, lo = R.high(s, "high", 20, 1), R.low(s, "low", 20, 1)
    ph, pl = R.prior(s, F.max, "high", 20), R.prior(s, F.min, "low", 20)
    c = F.col("close")
    s = s.add({"hi": hi, "lo": lo, "breakout": F.when(ph.isNotNull(), F.when(c > ph, c / ph - 1).when(c < pl, c / pl - 1).otherwise(0.0))})
    d = s.result().where("hi > lo")
    return d.select("symbol", "bar", clip(2 * (c - F.col("lo")) / (F.col("hi") - F.col("lo")) - 1, -1.0, 1.0).alias("donchian"), "breakout")


@query("trend_consistency", "H45 H13", f"WITH {_BASE} SELECT symbol, bar, avg(CASE WHEN lr > 0 THEN 1.0 ELSE 0 END) OVER {_R(24)} AS up_share, CASE WHEN avg(CASE WHEN lr > 0 THEN 1.0 ELSE 0 END) OVER {_R(24)} > 0.55 THEN 'UP' WHEN avg(CASE WHEN lr > 0 THEN 1.0 ELSE 0 END) OVER {_R(24)} < 0.45 THEN 'DOWN' ELSE 'CHOP' END AS regime FROM f1", "up_share")
def trend_consistency(spark, folder):
    from tidemark.functions.scalars import ind
    s = prepared(spark, folder, horizons=(24,))
    s = s.add({"up_share": F.avg(ind(F.col("log_ret") > 0)).over(s.rows(-23, 0))})
    return s.result("symbol", "bar", "up_share", F.when(F.col("up_share") > 0.55, "UP").when(F.col("up_share") < 0.45, "DOWN").otherwise("CHOP").alias("regime"))


@query("enriched_features", "H6 H8 H15 H26 H27")
def enriched_features(spark, folder):
    """All families for one horizon."""
    return X.enriched(bars(spark, folder), ["symbol"], "bar", (10,), bound=HOURS)


_LONG = (10, 20, 50, 200)
_EWM = lambda n: f"list_reduce(cl, lambda a, b: a + (b - a) * 2 / {n + 1}.0)"
_LH = f"""WITH {_BASE}, a AS (SELECT symbol, bar, c, i, {_EWM(20)} AS e20, {_EWM(50)} AS e50, lag(c, 720) OVER {_O} AS c720, lag(c, 168) OVER {_O} AS c168, sum(coalesce(sign(d), 0) * v) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS obv,
 {', '.join(f"{_G('avg(c)', 'c', n)} AS m{n}, {_G('stddev_samp(lr)', 'lr', n)} AS s{n}" for n in _LONG)} FROM (SELECT *, list(c) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS cl FROM f1)),
b AS (SELECT *, list(s200) OVER {_R(200)} AS hs, count(*) OVER {_R(200)} AS rows200 FROM a)
SELECT symbol, bar, {', '.join(f"{_SD(f's{n}', 's200')} AS volatility_ratio_{n}_200, {_SD(f'm{n} - m200', 'm200')} AS ma_spread_{n}_200, CASE WHEN m{n} > m200 THEN 1.0 ELSE 0 END AS moving_average_crossover_{n}_200" for n in _LONG[:-1])},
 CASE WHEN e20 > e50 THEN 1.0 ELSE 0 END AS fast_ema_cross, (CASE WHEN c > m200 THEN 1.0 ELSE 0 END + CASE WHEN m20 > m50 THEN 1 ELSE 0 END + CASE WHEN m50 > m200 THEN 1 ELSE 0 END) / 3 AS long_term_trend_score,
 {_SD('c - c720', 'c720')} AS monthly_trend, {_SD('c - c168', 'c168')} AS weekly_trend, CASE WHEN c > m200 THEN 1.0 ELSE -1 END AS sma_200_regime,
 CASE WHEN len(list_filter(hs, lambda q: q IS NOT NULL)) > 0 THEN len(list_filter(hs, lambda q: q <= s200)) / rows200 END AS long_term_volatility_percentile, {_G('coalesce(regr_slope(obv, i), 0)', 'obv', 200).replace('coalesce(regr_slope(obv, i), 0) OVER ' + _R(200), 'coalesce(regr_slope(obv, i) OVER ' + _R(200) + ', 0)')} AS long_term_volume_trend FROM b"""


@query("cross_horizon_features", "H24", _LH, " ".join(f"volatility_ratio_{n}_200 ma_spread_{n}_200 moving_average_crossover_{n}_200" for n in _LONG[:-1]) + " fast_ema_cross long_term_trend_score monthly_trend weekly_trend sma_200_regime long_term_volatility_percentile long_term_volume_trend", digits=4)
def cross_horizon_features(spark, folder):
    return X.long_horizon_table(bars(spark, folder), ["symbol"], "bar", _LONG, HOURS)


def _entropy_sql(n: int) -> str:
    k = f"count(g) OVER {_R(n)}"
    share = lambda v: f"(sum(CASE WHEN g = {v} THEN 1.0 ELSE 0 END) OVER {_R(n)})"
    both = f"{k} < 6 AND {share(-1)} > 0 AND {share(1)} > 0"
    parts = share(-1), f"(CASE WHEN {both} THEN 0 ELSE {share(0)} END)", f"(CASE WHEN {both} THEN {share(0)} + {share(1)} ELSE {share(1)} END)"
    total = " + ".join(f"CASE WHEN {p} > 0 THEN {p} / {k} * ln({p} / {k} + 1e-12) ELSE 0 END" for p in parts)
    used = " + ".join(f"CASE WHEN {p} > 0 THEN 1 ELSE 0 END" for p in parts)
    return f"CASE WHEN {k} >= 2 THEN -({total}) / ln({used} + 1e-12) ELSE 0 END"


_RUN = lambda cond: f"CAST(i - coalesce(max(CASE WHEN NOT coalesce({cond}, false) THEN i END) OVER {_O}, 0) AS BIGINT)"
_PAD = lambda x, n, zero="0.0::DOUBLE": f"list_concat(list_transform(range({n} - len(list({x}) OVER {_R(n)})), lambda q: {zero}), list({x}) OVER {_R(n)})"
_SQ = f"""WITH {_BASE}, g AS (SELECT *, sign(c - o) AS g, lag(v) OVER {_O} AS pv, lag(rg) OVER {_O} AS prg, {', '.join(f"{_SD('v', f'avg(v) OVER {_R(n)}')} - 1 AS v{n}, lag(c, {n}) OVER {_O} AS c{n}" for n in X.SEQUENCES)} FROM f1)
SELECT symbol, bar, {_RUN('c > o')} AS consecutive_green_candles, {_RUN('c < o')} AS consecutive_red_candles, {_RUN('c > pc')} AS consecutive_higher_closes, {_RUN('c < pc')} AS consecutive_lower_closes, {_RUN('v > pv')} AS consecutive_volume_increase, {_RUN('rg < prg')} AS consecutive_range_contraction,
 {', '.join(f"avg(lr) OVER {_R(n)} AS last_returns_mean_{n}, stddev_samp(lr) OVER {_R(n)} AS last_returns_std_{n}, avg(rg) OVER {_R(n)} AS last_ranges_mean_{n}, avg(v) OVER {_R(n)} AS last_volumes_mean_{n}, sum(g) OVER {_R(n)} AS last_candle_directions_sum_{n}, {_entropy_sql(n)} AS sequence_entropy_{n}, sum(g) OVER {_R(n)} / ({n} + 1e-12) AS pattern_embedding_{n}, {_SD(f'c - c{n}', f'c{n}')} AS nbar_return_path_{n}, {_PAD('coalesce(lr, 0)', n)} AS seq_last_returns_{n}, {_PAD('g::DOUBLE', n)} AS seq_last_candle_directions_{n}, {_PAD(f"[{_SD('o', 'c')} - 1, {_SD('h', 'c')} - 1, {_SD('l', 'c')} - 1, c * 0, v{n}]", n, '[0.0::DOUBLE, 0, 0, 0, 0]')} AS seq_last_candles_norm_{n}" for n in X.SEQUENCES)} FROM g"""


@query("sequence_features", "H29", _SQ, " ".join(f"{k}_{n}" for n in X.SEQUENCES for k in ("last_returns_mean", "last_returns_std", "last_ranges_mean", "last_volumes_mean", "last_candle_directions_sum", "sequence_entropy", "pattern_embedding", "nbar_return_path")), arrays=" ".join(f"seq_last_returns_{n}" for n in X.SEQUENCES))
def sequence_features(spark, folder):
    return X.candle_sequences(bars(spark, folder), ["symbol"], "bar", 60 * DAY_US, bound=HOURS)


@query("asymmetric_features", "H37 H38 H39", f"""WITH {_BASE}, y AS (SELECT *, CASE WHEN lr > 0 THEN v ELSE 0 END AS uv, CASE WHEN lr < 0 THEN v ELSE 0 END AS dnv, avg(v) OVER {_R(20)} AS v20 FROM f1) SELECT symbol, bar, (sum(uv) OVER {_R(12)} - sum(dnv) OVER {_R(12)}) / nullif(sum(v) OVER {_R(12)}, 0) AS volume_delta,
 sum(CASE WHEN v > 2 * v20 AND lr < 0 THEN 1.0 ELSE 0 END) OVER {_R(12)} AS long_flush, sum(CASE WHEN v > 2 * v20 AND lr > 0 THEN 1.0 ELSE 0 END) OVER {_R(12)} AS short_squeeze, c / min(l) OVER {_R(12)} - 1 AS rebound, c / max(h) OVER {_R(12)} - 1 AS fade FROM y""", "volume_delta long_flush short_squeeze rebound fade", digits=5)
def asymmetric_features(spark, folder):
    from tidemark.functions.scalars import div, flag, ind
    s = prepared(spark, folder, horizons=(20,))
    v, r = F.col("volume"), F.col("log_ret")
    s = s.add({"uv": ind(r > 0, v), "dnv": ind(r < 0, v), "v20": F.avg(v).over(s.rows(-19, 0))})
    s = s.add({"lf": flag((v > 2 * F.col("v20")) & (r < 0)), "sq": flag((v > 2 * F.col("v20")) & (r > 0))})
    w = s.rows(-11, 0)
    return s.add({"volume_delta": div(F.sum("uv").over(w) - F.sum("dnv").over(w), F.sum(v).over(w)), "long_flush": F.sum("lf").over(w), "short_squeeze": F.sum("sq").over(w),
                  "rebound": F.col("close") / F.min("low").over(w) - 1, "fade": F.col("close") / F.max("high").over(w) - 1}).result("symbol", "bar", "volume_delta", "long_flush", "short_squeeze", "rebound", "fade")
