"""OHLCV feature families over a blocked bar sequence.

Input columns: open, high, low, close, volume, quote_volume, trades. ``prepare`` adds the
shared base columns and, in one Arrow pass, every recursive average; each family then
only adds window columns on the same partitioning. Horizon columns end in ``_n``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clip, div, flag, ind, safe_div
from tidemark.operators import recurrence as K
from tidemark.operators import rolling as R
from tidemark.operators.blocks import Seq, running_total, sequence

HORIZONS = (1, 2, 3, 5, 10, 14, 20, 30, 50, 100, 200)
SEQUENCES = (3, 5, 10, 20)


def bar_columns() -> tuple[Column, ...]:
    return tuple(F.col(x) for x in ("open", "high", "low", "close", "volume"))


def look_back(horizons: Sequence[int], recursive: bool) -> int:
    n = max(horizons)
    return max(8 * n + 40, K.warmup(2 * n, 3)) if recursive else 8 * n + 40


def recursive_columns(horizons: Sequence[int]) -> dict:
    """Kernels of all averages that depend on their own last value."""
    out = {}
    bar = ["high", "low", "close"]
    for n in horizons:
        out |= {f"atr_{n}": (K.atr(n), bar), f"ema_{n}": (K.ema(n), ["close"]), f"ema2_{n}": (K.ema(2 * n), ["close"]), f"dema_{n}": (K.dema(n), ["close"]),
                f"tema_{n}": (K.tema(n), ["close"]), f"kama_{n}": (K.kama(n), ["close"]), f"rsi_{n}": (K.rsi(max(n, 2)), ["close"]),
                f"tsi_{n}": (K.tsi(max(n, 2)), ["close"]), f"trix_{n}": (K.trix(max(n, 2)), ["close"]), f"volume_ema_{n}": (K.ema(n), ["volume"]),
                f"adx_{n}": (K.directional(n, "adx"), bar), f"plus_di_{n}": (K.directional(n, "plus"), bar), f"minus_di_{n}": (K.directional(n, "minus"), bar)}
    return out


def prepare(df: DataFrame, keys: Sequence[str], clock: str, horizons: Sequence[int], recursive: bool = True, complexity: Sequence[int] = (),
            bound: int | None = None) -> Seq:
    s = sequence(df, keys, [clock], back=look_back(horizons, recursive), bound=bound)
    kernels = recursive_columns(horizons) if recursive else {}
    for n in complexity:
        x = ["close"]
        kernels |= {f"entropy_{n}": (K.histogram_entropy(n), x), f"hurst_{n}": (K.hurst(n), x), f"cycle_{n}": (K.spectrum(n, "cycle"), x),
                    f"fft1_{n}": (K.spectrum(n, "component", 1), x), f"fft2_{n}": (K.spectrum(n, "component", 2), x), f"spectral_entropy_{n}": (K.spectrum(n, "entropy"), x)}
    if kernels:
        s = K.kernel_pass(s, kernels)
    return base(s)


def base(s: Seq) -> Seq:
    """Prices, ranges, bodies, wicks and one-bar returns."""
    O, H, L, C, V = bar_columns()
    w = s.by()
    pc = F.lag("close").over(w)
    s = s.add({
        "prev_close": pc, "ret": div(C, pc) - 1.0, "log_ret": F.ln(safe_div(C, pc)), "delta": C - pc,
        "typical": (H + L + C) / 3.0, "median_price": (H + L) / 2.0, "weighted_close": (H + L + 2 * C) / 4.0, "ohlc_average": (O + H + L + C) / 4.0,
        "range": H - L, "body": F.abs(C - O), "upper_wick": H - F.greatest(O, C), "lower_wick": F.least(O, C) - L, "dollar_volume": C * V,
        "true_range": F.greatest(H - L, F.coalesce(F.abs(H - pc), F.lit(0.0)), F.coalesce(F.abs(L - pc), F.lit(0.0))),
        "place": F.row_number().over(w)})
    return s.add({"close_pos": safe_div(C - L, F.col("range")), "sign": F.signum("delta")})


def single_bar(s: Seq) -> Seq:
    O, H, L, C, V = bar_columns()
    w = s.by()
    lag = lambda x: F.lag(x).over(w)
    rg, body, up, dn = (F.col(x) for x in ("range", "body", "upper_wick", "lower_wick"))
    bull, was_bull = C > O, lag("close") > lag("open")
    small = safe_div(body, rg) < 0.1
    mean20 = lambda x: F.avg(x).over(s.rows(-19, 0))
    spread = safe_div(rg, C)
    return s.add({
        "gap": safe_div(O, F.col("prev_close")) - 1.0, "body_ratio": safe_div(body, rg), "upper_ratio": safe_div(up, rg), "lower_ratio": safe_div(dn, rg),
        "doji": flag(small), "hammer": flag((dn > 2 * body) & (up < body)), "star": flag((up > 2 * body) & (dn < body)),
        "engulfing": flag(bull & ~was_bull & (C >= lag("open")) & (O <= lag("close"))) - flag(~bull & was_bull & (O >= lag("close")) & (C <= lag("open"))),
        "inside": flag((H <= lag("high")) & (L >= lag("low"))), "outside": flag((H >= lag("high")) & (L <= lag("low"))),
        "pressure": 2 * F.col("close_pos") - 1.0, "illiquidity": safe_div(F.abs("ret"), F.col("dollar_volume")),
        "thin_market": flag((safe_div(V, mean20(V)) < 0.5) & (spread > mean20(spread)))})


def returns(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    m = R.min_periods(n)
    pc = F.lag("close", n).over(s.by())
    sma, sd = R.mean(s, C, n, m), R.std(s, C, n, m)
    hi, lo = R.high(s, H, n, m), R.low(s, L, n, m)
    s = s.add({f"return_{n}": div(C, pc) - 1.0, f"log_return_{n}": F.ln(safe_div(C, pc)), f"roc_{n}": safe_div(C - pc, pc),
               f"cumulative_{n}": F.exp(F.sum(F.coalesce("log_ret", F.lit(0.0))).over(s.rows(-(n - 1), 0))) - 1.0,
               f"norm_mean_{n}": safe_div(C, sma) - 1.0, f"norm_vol_{n}": safe_div(C - sma, sd), f"minmax_{n}": safe_div(C - lo, hi - lo),
               f"robust_{n}": safe_div(C - R.quantile(s, C, n, 0.5, m), R.quantile(s, C, n, 0.9, m) - R.quantile(s, C, n, 0.1, m)), f"diff_{n}": C - pc})
    return s.add({f"clipped_{n}": clip(f"log_return_{n}", -0.2, 0.2), f"acceleration_{n}": R.change(s, f"roc_{n}")})


def volatility(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    m = R.min_periods(n)
    hl, co = F.ln(safe_div(H, L)), F.ln(safe_div(C, O))
    rs = F.ln(safe_div(H, C)) * F.ln(safe_div(H, O)) + F.ln(safe_div(L, C)) * F.ln(safe_div(L, O))
    gap = F.ln(safe_div(O, F.col("prev_close")))
    rv = R.std(s, "log_ret", n, m)
    s = s.add({f"rv_{n}": rv, f"realised_{n}": rv * math.sqrt(n), f"parkinson_{n}": F.sqrt(safe_div(R.mean(s, hl * hl, n, m), F.lit(4 * math.log(2)))),
               f"garman_klass_{n}": F.sqrt(clip(R.mean(s, 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, n, m), 0.0)), f"rogers_{n}": F.sqrt(clip(R.mean(s, rs, n, m), 0.0)),
               f"range_expansion_{n}": safe_div("range", R.mean(s, "range", n, m)), f"_q90_{n}": R.quantile(s, "range", n, 0.9, m), f"_vr_{n}": safe_div(V, R.mean(s, V, n, m))})
    yz = gap * gap + co * co + F.col(f"rogers_{n}") * F.col(f"rogers_{n}")
    return s.add({f"yang_zhang_{n}": F.sqrt(clip(R.mean(s, yz, n, m), 0.0)), f"vol_acceleration_{n}": R.change(s, f"rv_{n}"), f"vol_percentile_{n}": R.rank_share(s, f"rv_{n}", n),
                  f"compression_{n}": flag(R.rank_share(s, "range", n) < 0.2), f"vol_breakout_{n}": flag(F.col("range") > F.lag(f"_q90_{n}").over(s.by())),
                  f"volume_adjusted_{n}": safe_div(f"rv_{n}", F.col(f"_vr_{n}"))})


def trend(s: Seq, n: int) -> Seq:
    """Needs the recursive columns of ``prepare``."""
    O, H, L, C, V = bar_columns()
    w, m = s.by(), R.min_periods(n)
    half, root = max(1, n // 2), max(1, int(math.sqrt(n)))
    s = s.add({"_hh": flag(H > F.lag("high").over(w)), "_ll": flag(L < F.lag("low").over(w)), f"sma_{n}": R.mean(s, C, n, m), f"wma_{n}": R.wma(s, C, n), f"_gap_{n}": 2 * R.wma(s, C, half) - R.wma(s, C, n)})
    s = s.add({f"hma_{n}": R.wma(s, f"_gap_{n}", root)})
    out = {f"above_sma_{n}": flag(C > F.col(f"sma_{n}")), f"above_ema_{n}": flag(C > F.col(f"ema_{n}"))}
    for k in ("sma", "ema", "hma", "kama"):
        out[f"distance_{k}_{n}"] = safe_div(C - F.col(f"{k}_{n}"), F.col(f"{k}_{n}"))
    for k in ("ema", "sma"):
        out[f"{k}_slope_{n}"] = safe_div(R.change(s, f"{k}_{n}"), C)
    out |= {f"trend_strength_{n}": safe_div(R.change(s, f"ema_{n}", n), F.col(f"atr_{n}")), f"slope_{n}": R.slope(s, C, n, "place"), f"r2_{n}": R.r2(s, C, n, "place"),
            f"persistence_{n}": safe_div(F.abs(F.sum("sign").over(s.rows(-(n - 1), 0))), F.lit(float(n))),
            f"higher_highs_{n}": F.sum("_hh").over(s.rows(-(n - 1), 0)),
            f"lower_lows_{n}": F.sum("_ll").over(s.rows(-(n - 1), 0))}
    return s.add(out)


def momentum(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    w, m = s.by(), R.min_periods(n)
    hi, lo = R.high(s, H, n, m), R.low(s, L, n, m)
    rsi = F.col(f"rsi_{n}")
    pc = F.col("prev_close")
    s = s.add({f"stoch_k_{n}": safe_div(C - lo, hi - lo), f"williams_{n}": -100.0 * safe_div(hi - C, hi - lo), f"momentum_{n}": C - F.lag("close", n).over(w),
               f"stoch_rsi_{n}": safe_div(rsi - R.low(s, rsi, n, m), R.high(s, rsi, n, m) - R.low(s, rsi, n, m)), f"macd_{n}": F.col(f"ema_{n}") - F.col(f"ema2_{n}"),
               f"ppo_{n}": 100.0 * safe_div(F.col(f"ema_{n}") - F.col(f"ema2_{n}"), F.col(f"ema2_{n}")), f"_tm_{n}": R.mean(s, "typical", n, m), f"_tl_{n}": F.collect_list("typical").over(s.rows(-(n - 1), 0)),
               "_bp": C - F.least(L, pc), "_uo": F.greatest(H, pc) - F.least(L, pc)})
    mad = F.aggregate(F.transform(f"_tl_{n}", lambda v: F.abs(v - F.col(f"_tm_{n}"))), F.lit(0.0), lambda a, v: a + v) / F.size(f"_tl_{n}")
    part = lambda k: safe_div(F.sum("_bp").over(s.rows(-(k - 1), 0)), F.sum("_uo").over(s.rows(-(k - 1), 0)))
    mid = F.col("median_price")
    fast, slow = max(2, min(n, 5)), max(3, min(max(2 * n, 3), 34))
    s = s.add({f"stoch_d_{n}": F.avg(f"stoch_k_{n}").over(s.rows(-2, 0)), f"cci_{n}": safe_div(F.col("typical") - F.col(f"_tm_{n}"), 0.015 * mad),
               f"ultimate_{n}": 100.0 * (4 * part(max(2, n)) + 2 * part(max(3, 2 * n)) + part(max(4, 4 * n))) / 7.0,
               f"awesome_{n}": F.avg(mid).over(s.rows(-(fast - 1), 0)) - F.avg(mid).over(s.rows(-(slow - 1), 0)), f"momentum_acceleration_{n}": R.change(s, f"momentum_{n}"),
               f"momentum_percentile_{n}": R.rank_share(s, f"momentum_{n}", n), **{f"_roc{k}_{n}": div(C, F.lag("close", k * n).over(w)) - 1.0 for k in (1, 2, 3, 4)}})
    kst = sum((k * F.avg(f"_roc{k}_{n}").over(s.rows(-(n - 1), 0)) for k in (2, 3, 4)), F.avg(f"_roc1_{n}").over(s.rows(-(n - 1), 0)))
    return s.add({f"kst_{n}": kst})


def reversion(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    m = R.min_periods(n)
    sma, sd, hi, lo = R.mean(s, C, n, m), R.std(s, C, n, m), R.high(s, H, n, m), R.low(s, L, n, m)
    up, dn = sma + 2 * sd, sma - 2 * sd
    ema, atr = F.col(f"ema_{n}"), F.col(f"atr_{n}")
    z = safe_div(C - sma, sd)
    vwap = safe_div(F.sum(F.col("typical") * V).over(s.rows(-(n - 1), 0)), F.sum(V).over(s.rows(-(n - 1), 0)))
    calm = clip(1.0 - F.abs(safe_div(F.col(f"rsi_{n}") - 50.0, F.lit(50.0))), 0.0, 1.0)
    return s.add({f"z_price_{n}": z, f"z_return_{n}": R.z_safe(s, "log_ret", n), f"bb_upper_{n}": up, f"bb_lower_{n}": dn, f"bb_width_{n}": safe_div(up - dn, sma), f"bb_percent_{n}": safe_div(C - dn, up - dn),
                  f"keltner_upper_{n}": ema + 2 * atr, f"keltner_lower_{n}": ema - 2 * atr, f"keltner_width_{n}": safe_div(4 * atr, ema), f"donchian_pos_{n}": safe_div(C - lo, hi - lo),
                  f"vwap_dev_{n}": safe_div(C - vwap, vwap), f"reversion_pressure_{n}": F.abs(z) * calm, f"overextension_{n}": F.abs(z) * safe_div(atr, C)})


def volume(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    m = R.min_periods(n)
    w = s.rows(-(n - 1), 0)
    vm, vs = R.mean(s, V, n, m), R.std(s, V, n, m)
    flow = safe_div((C - L) - (H - C), H - L) * V
    tp, ptp = F.col("typical"), F.lag("typical").over(s.by())
    s = s.add({"_mf_up": ind(tp > ptp, tp * V), "_mf_dn": ind(tp < ptp, tp * V), "_emv": safe_div(R.change(s, "median_price"), safe_div(V, H - L)), "_flow": flow, f"volume_ratio_{n}": safe_div(V, vm), f"volume_z_{n}": safe_div(V - vm, vs)})
    up = ind(C >= O, V)
    return s.add({f"volume_percentile_{n}": R.rank_share(s, V, n), f"volume_spike_{n}": flag(F.col(f"volume_z_{n}") > 2), f"volume_dry_{n}": flag(F.col(f"volume_ratio_{n}") < 0.5),
                  f"cmf_{n}": safe_div(R.total(s, "_flow", n, m), R.total(s, V, n, m)), f"mfi_{n}": 100.0 - 100.0 / (1.0 + safe_div(F.sum("_mf_up").over(w), F.sum("_mf_dn").over(w))),
                  f"force_{n}": R.change(s, C, n) * V, f"eom_{n}": R.mean(s, "_emv", n, m), f"volume_imbalance_{n}": safe_div(F.sum(up).over(w) - F.sum(V - up).over(w), F.sum(V).over(w))})


def accumulated_volume(s: Seq, width: int = 60 * 86_400_000_000):
    """Running totals over the whole history: on-balance volume, accumulation, price trend, and the two volume indices from 1000 (and the logs of their growth)."""
    O, H, L, C, V = bar_columns()
    pc, pv = F.lag("close").over(s.by()), F.lag("volume").over(s.by())
    growth = F.ln(C / pc)
    d = s.add({"_ob": F.coalesce(F.signum(C - pc), F.lit(0.0)) * V, "_fl": F.coalesce(safe_div((C - L) - (H - C), H - L) * V, F.lit(0.0)), "_vp": F.coalesce(C / pc - 1, F.lit(0.0)) * V,
               "_dn": F.when(V < pv, growth).otherwise(0.0), "_up": F.when(V > pv, growth).otherwise(0.0)}).result(*s.keys, *s.order, "_ob", "_fl", "_vp", "_dn", "_up")
    d = running_total(d, s.keys, s.order, {"obv": F.col("_ob"), "accumulation": F.col("_fl"), "volume_price_trend": F.col("_vp"), "_n": F.col("_dn"), "_p": F.col("_up")}, width)
    return d.select(*s.keys, *s.order, "obv", "accumulation", "volume_price_trend", (1000 * F.exp("_n")).alias("negative_volume_index"), (1000 * F.exp("_p")).alias("positive_volume_index"),
                    F.col("_n").alias("negative_volume_log"), F.col("_p").alias("positive_volume_log"))


def liquidity(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    w = s.rows(-(n - 1), 0)
    tot = F.sum(V).over(w)
    return s.add({f"vwap_{n}": safe_div(F.sum(F.col("typical") * V).over(w), tot), f"vw_return_{n}": safe_div(F.sum(F.col("ret") * V).over(w), tot), f"impact_{n}": safe_div(F.abs("ret"), tot),
                  f"liquidity_{n}": safe_div(tot, F.sum("range").over(w)), f"amihud_{n}": safe_div(F.avg(F.abs("ret")).over(w), F.avg("dollar_volume").over(w)),
                  f"absorption_{n}": safe_div(V, R.mean(s, V, n, R.min_periods(n))) * clip(1.0 - safe_div("body", "range"), 0.0, 1.0)})


def levels(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    w, m = s.by(), R.min_periods(n)
    s = s.add({f"high_{n}": R.high(s, H, n, m), f"low_{n}": R.low(s, L, n, m), "_pivot": (F.lag("high").over(w) + F.lag("low").over(w) + F.col("prev_close")) / 3.0,
               "_reject": flag((F.col("upper_wick") + F.col("lower_wick")) > 2 * F.col("body"))})
    hi, lo, p = F.col(f"high_{n}"), F.col(f"low_{n}"), F.col("_pivot")
    out = {f"distance_high_{n}": safe_div(hi - C, C), f"distance_low_{n}": safe_div(C - lo, C), f"breakout_{n}": flag(C > F.lag(f"high_{n}").over(w)), f"breakdown_{n}": flag(C < F.lag(f"low_{n}").over(w)),
           f"pivot_{n}": p, f"pivot_r1_{n}": 2 * p - F.lag("low").over(w), f"pivot_s1_{n}": 2 * p - F.lag("high").over(w), f"distance_pivot_{n}": safe_div(C - p, C),
           f"swing_high_{n}": flag((H == hi) & (F.lag("high").over(w) < H)), f"swing_low_{n}": flag((L == lo) & (F.lag("low").over(w) > L)), f"rejections_{n}": F.sum("_reject").over(s.rows(-(n - 1), 0))}
    for r in (0.236, 0.382, 0.5, 0.618, 0.786):
        out[f"fib_{str(r)[2:]}_{n}"] = hi - r * (hi - lo)
    return s.add(out)


def structure(s: Seq, n: int) -> Seq:
    """Needs ``levels`` and ``volume`` of the same horizon."""
    O, H, L, C, V = bar_columns()
    w = s.by()
    ph, pl = F.lag(f"high_{n}").over(w), F.lag(f"low_{n}").over(w)
    return s.add({f"higher_high_{n}": flag(H > ph), f"higher_low_{n}": flag(L > pl), f"lower_high_{n}": flag(H < ph), f"lower_low_{n}": flag(L < pl),
                  f"pullback_depth_{n}": safe_div(F.col(f"high_{n}") - C, F.col(f"high_{n}") - F.col(f"low_{n}")), f"false_breakout_{n}": flag((H > ph) & (C <= ph)) - flag((L < pl) & (C >= pl)),
                  f"confirmed_breakout_{n}": flag((C > ph) & (F.col(f"volume_ratio_{n}") > 1.25))})


def directional(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    w = s.rows(-(n - 1), 0)
    got = F.collect_list(F.struct(H.alias("h"), L.alias("l"))).over(w)
    s = s.add({"_got": got, "_vp": F.abs(H - F.lag("low").over(s.by())), "_vm": F.abs(L - F.lag("high").over(s.by()))})
    k = F.size("_got")
    hs, ls = F.transform("_got", lambda v: v["h"]), F.transform("_got", lambda v: v["l"])
    age = lambda arr, best: 100.0 * (k - F.array_position(arr, best)) / F.greatest(k - 1, F.lit(1))
    tr = F.sum("true_range").over(w)
    width = F.greatest(F.max(H).over(w) - F.min(L).over(w), F.lit(1e-12))
    return s.add({f"aroon_up_{n}": age(hs, F.array_max(hs)), f"aroon_down_{n}": age(ls, F.array_min(ls)), f"vortex_plus_{n}": safe_div(F.sum("_vp").over(w), tr), f"vortex_minus_{n}": safe_div(F.sum("_vm").over(w), tr),
                  f"choppiness_{n}": 100.0 * safe_div(F.log10(safe_div(tr, width)), F.lit(math.log10(max(n, 2)))),
                  f"efficiency_{n}": safe_div(F.abs(C - F.lag("close", n).over(s.by())), F.sum(F.abs("delta")).over(w))})


def squeeze(s: Seq, n: int) -> Seq:
    """Needs ``reversion`` and ``volatility`` of the same horizon."""
    return s.add({f"ttm_squeeze_{n}": flag((F.col(f"bb_upper_{n}") < F.col(f"keltner_upper_{n}")) & (F.col(f"bb_lower_{n}") > F.col(f"keltner_lower_{n}"))),
                  f"bb_squeeze_{n}": flag(R.rank_share(s, f"bb_width_{n}", n) < 0.2), f"contraction_{n}": flag(R.change(s, f"rv_{n}") < 0)})


def statistics(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    m = R.min_periods(n)
    r = F.col("log_ret")
    s = s.add({"_r1": F.lag("log_ret").over(s.by())})
    down = F.when(r < 0, r)
    w = s.rows(-(n - 1), 0)
    return s.add({f"mean_{n}": R.mean(s, r, n, m), f"median_{n}": R.quantile(s, r, n, 0.5, m), f"std_{n}": R.std(s, r, n, m), f"min_{n}": R.low(s, r, n, m), f"max_{n}": R.high(s, r, n, m),
                  f"skew_{n}": R.skewness(s, r, n), f"kurt_{n}": R.kurtosis(s, r, n), f"q25_{n}": R.quantile(s, r, n, 0.25, m), f"q75_{n}": R.quantile(s, r, n, 0.75, m), f"autocorr_{n}": R.autocorrelation(s, r, "_r1", n, m),
                  f"volume_corr_{n}": R.correlation(s, r, V, n, m), f"drawdown_{n}": R.max_drawdown(s, C, n), f"sharpe_{n}": R.sharpe(s, r, n, m), f"sortino_{n}": safe_div(R.mean(s, r, n, m), F.stddev_samp(down).over(w)),
                  f"win_rate_{n}": F.avg(ind(r > 0)).over(w)})


def risk(s: Seq, n: int) -> Seq:
    O, H, L, C, V = bar_columns()
    w, m = s.rows(-(n - 1), 0), R.min_periods(n)
    r = F.col("log_ret")
    sd = R.std(s, r, n, m)
    z = R.z_safe(s, r, n)
    return s.add({f"downside_{n}": F.coalesce(F.stddev_samp(F.when(r < 0, r)).over(w), F.lit(0.0)), f"upside_{n}": F.coalesce(F.stddev_samp(F.when(r > 0, r)).over(w), F.lit(0.0)),
                  f"tail_{n}": safe_div(R.quantile(s, r, n, 0.05, m), sd), f"crash_{n}": clip(-safe_div(r, sd), 0.0), f"pump_{n}": clip(safe_div(r, sd), 0.0), f"anomaly_{n}": flag(F.abs(z) > 3),
                  f"liquidity_shock_{n}": flag(R.z_safe(s, V, n) > 3), f"slippage_{n}": safe_div("range", F.col("dollar_volume")), f"turnover_{n}": F.sum("dollar_volume").over(w)})


def regimes(s: Seq, n: int) -> Seq:
    """Needs ``trend``, ``volatility``, ``volume`` and ``directional`` of the same horizon."""
    O, H, L, C, V = bar_columns()
    ts, vp, vr, ch = F.col(f"trend_strength_{n}"), F.col(f"vol_percentile_{n}"), F.col(f"volume_ratio_{n}"), F.col(f"choppiness_{n}")
    return s.add({f"trend_regime_{n}": F.when(ts > 0.25, 1.0).when(ts < -0.25, -1.0).otherwise(0.0), f"vol_regime_{n}": F.when(vp > 0.8, 2.0).when(vp < 0.2, 0.0).otherwise(1.0),
                  f"volume_regime_{n}": F.when(vr > 1.5, 2.0).when(vr < 0.5, 0.0).otherwise(1.0), f"choppy_{n}": flag(ch > 61.8), f"trending_{n}": flag(ch < 38.2), f"signal_noise_{n}": F.col(f"efficiency_{n}"),
                  f"breakout_strength_{n}": safe_div(C - F.lag(f"high_{n}").over(s.by()), F.col(f"atr_{n}")), f"pullback_ema_{n}": safe_div(C - F.col(f"ema_{n}"), F.col(f"atr_{n}")),
                  f"atr_distance_high_{n}": safe_div(F.col(f"high_{n}") - C, F.col(f"atr_{n}")), f"atr_distance_low_{n}": safe_div(C - F.col(f"low_{n}"), F.col(f"atr_{n}"))})


def sessions(df: DataFrame, keys: Sequence[str], clock: str, day_us: int) -> DataFrame:
    """UTC-day open, high, low, VWAP and volume so far, opening range and daily run-up; a day bounds each window."""
    O, H, L, C, V = bar_columns()
    w = Window.partitionBy(*keys, F.floor(c(clock) / day_us)).orderBy(clock).rowsBetween(Window.unboundedPreceding, 0)
    tp = (H + L + C) / 3.0
    d = df.withColumns({"session_open": F.first("open").over(w), "session_high": F.max("high").over(w), "session_low": F.min("low").over(w), "session_volume": F.sum("volume").over(w),
                        "session_vwap": safe_div(F.sum(tp * V).over(w), F.sum("volume").over(w)), "session_bar": F.row_number().over(w)})
    first = F.when(F.col("session_bar") <= 4, F.col("high")), F.when(F.col("session_bar") <= 4, F.col("low"))
    return d.withColumns({"opening_high": F.max(first[0]).over(w), "opening_low": F.min(first[1]).over(w), "session_return": div(C, "session_open") - 1.0, "session_drawdown": div(C, "session_high") - 1.0,
                          "vwap_distance": safe_div(C - F.col("session_vwap"), F.col("session_vwap"))})


def calendar_columns(clock: str) -> dict[str, Column]:
    ts = F.timestamp_micros(c(clock))
    hour, dow, month = F.hour(ts), F.dayofweek(ts) - 1, F.month(ts)
    turn = 2 * math.pi
    return {"hour": hour, "dow": dow, "month": month, "hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24), "dow_sin": F.sin(turn * dow / 7), "dow_cos": F.cos(turn * dow / 7),
            "asia": flag(hour < 8), "europe": flag((hour >= 7) & (hour < 16)), "america": flag((hour >= 13) & (hour < 22)), "weekend": flag(dow.isin(0, 6)), "hours_to_close": 24 - hour}


def patterns(s: Seq, n: int) -> Seq:
    """Double and triple tops and bottoms, triangles, wedges and flags from highs, lows and slopes."""
    O, H, L, C, V = bar_columns()
    m = R.min_periods(n)
    s = s.add({"_sh": R.slope(s, H, n, "place"), "_sl": R.slope(s, L, n, "place"), "_h2": R.high(s, H, 2 * n, m), "_l2": R.low(s, L, 2 * n, m), f"_hn_{n}": R.high(s, H, n, m), f"_ln_{n}": R.low(s, L, n, m)})
    tol = 0.005
    near = lambda a, b: F.abs(safe_div(a - b, b)) < tol
    older_h, older_l = F.lag(f"_hn_{n}", n).over(s.by()), F.lag(f"_ln_{n}", n).over(s.by())
    sh, sl = F.col("_sh"), F.col("_sl")
    top, bottom = near(F.col(f"_hn_{n}"), older_h), near(F.col(f"_ln_{n}"), older_l)
    return s.add({f"double_top_{n}": flag(top & (C < F.col(f"_hn_{n}"))), f"double_bottom_{n}": flag(bottom & (C > F.col(f"_ln_{n}"))),
                  f"triple_top_{n}": flag(top & near(older_h, F.lag(f"_hn_{n}", 2 * n).over(s.by()))), f"triple_bottom_{n}": flag(bottom & near(older_l, F.lag(f"_ln_{n}", 2 * n).over(s.by()))),
                  f"ascending_triangle_{n}": flag((F.abs(sh) < 1e-3 * C) & (sl > 0)), f"descending_triangle_{n}": flag((F.abs(sl) < 1e-3 * C) & (sh < 0)), f"symmetric_triangle_{n}": flag((sh < 0) & (sl > 0)),
                  f"rising_wedge_{n}": flag((sh > 0) & (sl > sh)), f"falling_wedge_{n}": flag((sl < 0) & (sh < sl))})


def cross_horizon(s: Seq, short: int, long: int) -> Seq:
    """Needs ``trend`` and ``volatility`` of both horizons."""
    w = s.by()
    a, b = F.col(f"sma_{short}"), F.col(f"sma_{long}")
    above = a > b
    return s.add({f"sma_ratio_{short}_{long}": safe_div(a, b), f"vol_ratio_{short}_{long}": safe_div(f"rv_{short}", F.col(f"rv_{long}")),
                  f"golden_cross_{short}_{long}": flag(above & ~(F.lag(f"sma_{short}").over(w) > F.lag(f"sma_{long}").over(w))), f"death_cross_{short}_{long}": flag(~above & (F.lag(f"sma_{short}").over(w) > F.lag(f"sma_{long}").over(w)))})


def long_horizon(s: Seq, horizons: Sequence[int], long: int = 200) -> Seq:
    """Columns of each horizon against ``long`` rows, and long-term scores. Needs ``sma_n`` and ``rv_n`` of all horizons, ``ema_20`` and ``ema_50``."""
    O, H, L, C, V = bar_columns()
    w, wide = s.by(), s.rows(-(long - 1), 0)
    sma = lambda n: F.col(f"sma_{n}")
    out = {}
    for n in (x for x in horizons if x < long and long in horizons):
        out |= {f"volatility_ratio_{n}_{long}": safe_div(f"rv_{n}", f"rv_{long}"), f"ma_spread_{n}_{long}": safe_div(sma(n) - sma(long), sma(long)),
                f"moving_average_crossover_{n}_{long}": flag(sma(n) > sma(long))}
    if {20, 50} <= set(horizons):
        out["fast_ema_cross"] = flag(F.col("ema_20") > F.col("ema_50"))
    if {20, 50, 200} <= set(horizons):
        month, week = F.lag("close", 720).over(w), F.lag("close", 168).over(w)
        out |= {"long_term_trend_score": (flag(C > sma(200)) + flag(sma(20) > sma(50)) + flag(sma(50) > sma(200))) / 3.0, "monthly_trend": safe_div(C - month, month),
                "weekly_trend": safe_div(C - week, week), "sma_200_regime": F.when(C > sma(200), 1.0).otherwise(-1.0)}
    if long in horizons:
        out["long_term_volatility_percentile"] = F.when(F.count(f"rv_{long}").over(wide) > 0, R.rank_share(s, f"rv_{long}", long))
    # a slope does not depend on where the volume count began, so the count may start at the block's copied rows
    s = s.add({"_flow": F.coalesce(F.signum("delta"), F.lit(0.0)) * V})
    s = s.add({"_obv": F.sum("_flow").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out["long_term_volume_trend"] = R.slope(s, "_obv", min(200, max(horizons)), "place")
    return s.add(out)


def long_horizon_table(df: DataFrame, keys: Sequence[str], clock: str, horizons: Sequence[int] = HORIZONS, bound: int | None = None) -> DataFrame:
    """``long_horizon`` on plain bars."""
    s = sequence(df, keys, [clock], back=max(8 * max(horizons) + 40, 760, K.warmup(50)), bound=bound)
    s = base(K.kernel_pass(s, {f"ema_{n}": (K.ema(n), ["close"]) for n in (20, 50)}))
    s = s.add({k: v for n in horizons for k, v in ((f"sma_{n}", R.mean(s, "close", n, R.min_periods(n))), (f"rv_{n}", R.std(s, "log_ret", n, R.min_periods(n))))})
    had = set(s.df.columns)
    s = long_horizon(s, horizons)
    return s.result(*keys, clock, *[x for x in s.df.columns if x not in had and not x.startswith("_")])


def candle_sequences(df: DataFrame, keys: Sequence[str], clock: str, width: int, horizons: Sequence[int] = SEQUENCES, bound: int | None = None) -> DataFrame:
    """Run lengths of candle conditions, statistics of the last n bars, and the last bars as arrays (n of 20 at most)."""
    O, H, L, C, V = bar_columns()
    s = sequence(df, keys, [clock], back=1, bound=bound)
    lag = lambda x: F.lag(x).over(s.by())
    rg = lambda h, l: F.greatest(h - l, F.lit(0.0))
    d = s.add({"_up": C > lag("close"), "_down": C < lag("close"), "_more": V > lag("volume"), "_narrow": rg(H, L) < rg(lag("high"), lag("low"))}).result()
    d = K.add_run_lengths(d, keys, [clock], {
        "consecutive_green_candles": C > O, "consecutive_red_candles": C < O, "consecutive_higher_closes": F.col("_up"), "consecutive_lower_closes": F.col("_down"),
        "consecutive_volume_increase": F.col("_more"), "consecutive_range_contraction": F.col("_narrow")}, width)
    runs = [x for x in d.columns if x.startswith("consecutive_")]
    s = sequence(d, keys, [clock], back=max(horizons) + 1, bound=bound)
    s = s.add({"_lr": F.ln(safe_div(C, lag("close"))), "_rg": rg(H, L), "_dir": F.signum(C - O)})
    s = s.add({f"_v_{n}": safe_div(V, F.avg(V).over(s.rows(-(n - 1), 0))) - 1.0 for n in horizons} | {"_o": safe_div(O, C) - 1.0, "_h": safe_div(H, C) - 1.0, "_l": safe_div(L, C) - 1.0, "_c": C * 0.0})
    out = {}
    for n in horizons:
        w, past = s.rows(-(n - 1), 0), F.lag("close", n).over(s.by())
        total = F.sum("_dir").over(w)
        out |= {f"last_returns_mean_{n}": F.avg("_lr").over(w), f"last_returns_std_{n}": F.stddev_samp("_lr").over(w), f"last_ranges_mean_{n}": F.avg("_rg").over(w), f"last_volumes_mean_{n}": F.avg(V).over(w),
                f"last_candle_directions_sum_{n}": total, f"sequence_entropy_{n}": R.direction_entropy(s, "_dir", n), f"pattern_embedding_{n}": safe_div(total, F.lit(float(n))), f"nbar_return_path_{n}": safe_div(C - past, past)}
        if n <= 20:
            out |= {f"seq_last_returns_{n}": R.padded_list(s, "_lr", n), f"seq_last_candle_directions_{n}": R.padded_list(s, "_dir", n),
                    f"seq_last_candles_norm_{n}": R.padded_matrix(s, ["_o", "_h", "_l", "_c", f"_v_{n}"], n)}
    return s.add(out).result(*keys, clock, *runs, *out)


def scores(s: Seq, n: int) -> Seq:
    """Stops, targets and composite scores over the columns of the other families."""
    O, H, L, C, V = bar_columns()
    atr = F.col(f"atr_{n}")
    squash = lambda x: F.tanh(x)
    return s.add({f"stop_long_{n}": C - 1.5 * atr, f"target_long_{n}": C + 3.0 * atr, f"reward_risk_{n}": safe_div(F.col(f"high_{n}") - C, C - F.col(f"low_{n}")), f"size_proxy_{n}": safe_div(F.lit(0.01), safe_div(atr, C)),
                  f"trend_score_{n}": squash(F.col(f"trend_strength_{n}")) * F.col(f"r2_{n}"), f"momentum_score_{n}": safe_div(F.col(f"rsi_{n}") - 50.0, F.lit(50.0)),
                  f"reversal_score_{n}": -squash(F.col(f"z_price_{n}") / 2.0), f"breakout_score_{n}": F.col(f"breakout_{n}") * F.col(f"volume_ratio_{n}")})


def enriched(df: DataFrame, keys: Sequence[str], clock: str, horizons: Sequence[int], complexity: Sequence[int] = (), bound: int | None = None) -> DataFrame:
    """All families for all horizons; one shuffle for the Arrow pass, one for the windows."""
    s = single_bar(prepare(df, keys, clock, horizons, True, complexity, bound))
    for n in horizons:
        for family in (returns, volatility, trend, momentum, reversion, volume, liquidity, levels, structure, directional, squeeze, statistics, risk, regimes, scores, patterns):
            s = family(s, n)
    if len(horizons) > 1:
        s = long_horizon(cross_horizon(s, horizons[0], horizons[-1]), horizons)
    s = s.add(calendar_columns(clock))
    d = s.result()
    return d.select(*[x for x in d.columns if not x.startswith("_")])
