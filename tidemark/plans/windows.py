"""Rolling statistics, runs and recurrences over bars and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, div, flag
from tidemark.operators import recurrence as K
from tidemark.operators import rolling as R
from tidemark.operators.blocks import DAYS, HOURS, RN, number_rows, running_total, sequence
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, PANEL, TICKS, bars, panel, ticks

_RET = f"""{BARS}, x AS (SELECT *, row_number() OVER w AS i, ln(close / lag(close) OVER w) AS r, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar))"""
_W = lambda n, lo=0: f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n} PRECEDING AND {'CURRENT ROW' if lo == 0 else str(lo) + ' PRECEDING'})"
_ORD = "(PARTITION BY symbol ORDER BY bar)"


def ret_bars(spark, folder, back=64, ahead=0):
    s = sequence(bars(spark, folder), ["symbol"], ["bar"], back=back + 2, ahead=ahead, bound=HOURS)
    s = s.add({"r": F.ln(F.col("close") / R.lag(s, "close")), "d": R.change(s, "close")})
    return s


@query("prior_zscore", "E1 E10", f"""WITH {_RET} SELECT symbol, bar, CASE WHEN count(r) OVER w >= 10 THEN (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) END AS z,
 CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS sd FROM x WINDOW w AS {_W(20, 1)}""", "z sd")
def prior_zscore(spark, folder):
    s = ret_bars(spark, folder)
    return s.add({"z": R.prior_z(s, "r", 20, 10), "sd": R.prior(s, F.stddev_samp, "r", 20)}).result("symbol", "bar", "z", "sd")


@query("ticks_prior_zscore", "E1", f"""WITH {TICKS} SELECT event_id, CASE WHEN count(price) OVER w >= 10 THEN (price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0) END AS z
 FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""", "z")
def ticks_prior_zscore(spark, folder):
    s = sequence(ticks(spark, folder).select("event_id", "symbol", "ts_us", "price"), ["symbol"], ["ts_us", "event_id"], back=50)
    return s.add({"z": R.prior_z(s, "price", 50, 10)}).result("event_id", "z")


@query("time_window_zscore", "E2 E3", f"""WITH {_RET}, y AS (SELECT *, lag(close) OVER {_ORD} AS p FROM x)
SELECT symbol, bar, CASE WHEN count(p) OVER w >= 6 THEN (close - avg(p) OVER w) / nullif(stddev_samp(p) OVER w, 0) END AS z FROM y
 WINDOW w AS (PARTITION BY symbol ORDER BY bar RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW)""", "z")
def time_window_zscore(spark, folder):
    # A day of hourly bars holds at most 24 rows, so 26 copied rows cover the time frame.
    s = sequence(bars(spark, folder), ["symbol"], ["bar"], back=26, bound=HOURS)
    s = s.add({"p": R.lag(s, "close")})
    w = s.by().rangeBetween(-(DAY_US - 1), 0)
    z = F.when(F.count("p").over(w) >= 6, div(F.col("close") - F.avg("p").over(w), F.stddev_samp("p").over(w)))
    return s.add({"z": z}).result("symbol", "bar", "z")


@query("inclusive_zscore", "E4 E5", f"""WITH {_RET} SELECT symbol, bar, CASE WHEN count(close) OVER w = 30 THEN (close - avg(close) OVER w) / (stddev_samp(close) OVER w + 1e-12) END AS z_full,
 CASE WHEN count(close) OVER w >= 15 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z_half FROM x WINDOW w AS {_W(29)}""", "z_full z_half")
def inclusive_zscore(spark, folder):
    s = ret_bars(spark, folder)
    return s.add({"z_full": R.z_full(s, "close", 30), "z_half": R.z_plain(s, "close", 30, 15)}).result("symbol", "bar", "z_full", "z_half")


@query("prior_percentile_rank", "E6 E7 E8", f"""WITH {_RET}, y AS (SELECT symbol, bar, close, list(close) OVER {_W(40, 1)} AS h FROM x)
SELECT symbol, bar, CASE WHEN len(h) >= 40 THEN len(list_filter(h, lambda v: v <= close)) / len(h)::DOUBLE END AS share, CASE WHEN len(h) >= 1 THEN len(list_filter(h, lambda v: v <= close)) / len(h)::DOUBLE END AS share_any FROM y""", "share share_any")
def prior_percentile_rank(spark, folder):
    s = ret_bars(spark, folder)
    return s.add({"share": R.prior_rank_share(s, "close", 40), "share_any": R.prior_rank_share(s, "close", 40, 1)}).result("symbol", "bar", "share", "share_any")


@query("prior_rank_wide", "E6", f"""WITH {_RET}, y AS (SELECT symbol, bar, close, list(close) OVER {_W(300, 1)} AS h FROM x)
SELECT symbol, bar, CASE WHEN len(h) >= 100 THEN len(list_filter(h, lambda v: v <= close)) / len(h)::DOUBLE END AS share FROM y""", "share")
def prior_rank_wide(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], back=300, bound=HOURS)
    return K.kernel_pass(s, {"share": (K.prior_rank(300, 100), ["close"])}).result("symbol", "bar", "share")


@query("inclusive_percentile_rank", "E9", f"""WITH {_RET}, y AS (SELECT symbol, bar, volume, list(volume) OVER {_W(19)} AS h FROM x)
SELECT symbol, bar, len(list_filter(h, lambda v: v <= volume)) / len(h)::DOUBLE AS share FROM y""", "share")
def inclusive_percentile_rank(spark, folder):
    s = ret_bars(spark, folder)
    return s.add({"share": R.rank_share(s, "volume", 20)}).result("symbol", "bar", "share")


@query("regression_slope", "E11 E12", f"""WITH {_RET} SELECT symbol, bar, CASE WHEN count(close) OVER w >= 6 THEN coalesce(regr_slope(close, i) OVER w, 0) END AS slope,
 CASE WHEN count(close) OVER w >= 6 THEN CASE WHEN count(close) OVER w < 3 OR var_pop(close) OVER w * count(close) OVER w <= 1e-12 THEN 0 ELSE coalesce(regr_r2(close, i) OVER w, 0) END END AS r2
 FROM x WINDOW w AS {_W(19)}""", "slope r2")
def regression_slope(spark, folder):
    d = number_rows(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], 60 * DAY_US)
    s = sequence(d.withColumnRenamed(RN, "i"), ["symbol"], ["bar"], back=20, bound=HOURS)
    return s.add({"slope": R.slope(s, "close", 20, "i"), "r2": R.r2(s, "close", 20, "i")}).result("symbol", "bar", "slope", "r2")


@query("rolling_correlations", "E13 E14 E15", f"""WITH {_RET}, y AS (SELECT *, lag(r) OVER {_ORD} AS r1, lag(r, 3) OVER {_ORD} AS r3, ln(volume + 1) AS lv FROM x)
SELECT symbol, bar, CASE WHEN count(CASE WHEN r IS NOT NULL AND r1 IS NOT NULL THEN 1 END) OVER w = 24 THEN corr(r, r1) OVER w END AS ac1,
 CASE WHEN count(CASE WHEN r IS NOT NULL AND r3 IS NOT NULL THEN 1 END) OVER w = 24 THEN corr(r, r3) OVER w END AS ac3,
 coalesce(CASE WHEN count(CASE WHEN r IS NOT NULL AND lv IS NOT NULL THEN 1 END) OVER w >= 8 THEN corr(r, lv) OVER w END, 0) AS rv FROM y WINDOW w AS {_W(23)}""", "ac1 ac3 rv")
def rolling_correlations(spark, folder):
    s = ret_bars(spark, folder)
    s = s.add({"r1": R.lag(s, "r"), "r3": R.lag(s, "r", 3), "lv": F.ln(F.col("volume") + 1)})
    return s.add({"ac1": R.correlation(s, "r", "r1", 24), "ac3": R.correlation(s, "r", "r3", 24),
                  "rv": R.autocorrelation(s, "r", "lv", 24, 8)}).result("symbol", "bar", "ac1", "ac3", "rv")


@query("sign_entropy", "E17 E31", f"""WITH {_RET}, y AS (SELECT *, sign(r) AS s, CASE WHEN sign(r) <> lag(sign(r)) OVER {_ORD} THEN 1.0 WHEN r IS NULL OR lag(r) OVER {_ORD} IS NULL THEN NULL ELSE 0 END AS flip FROM x),
z AS (SELECT symbol, bar, flip, count(s) OVER w AS n, count(*) FILTER (s = 1) OVER w AS a, count(*) FILTER (s = -1) OVER w AS b, count(*) FILTER (s = 0) OVER w AS e, avg(flip) OVER w AS density FROM y WINDOW w AS {_W(19)})
SELECT symbol, bar, CASE WHEN n >= 20 THEN -(CASE WHEN a > 0 THEN a / n::DOUBLE * ln(a / n::DOUBLE) ELSE 0 END) - (CASE WHEN b > 0 THEN b / n::DOUBLE * ln(b / n::DOUBLE) ELSE 0 END) - (CASE WHEN e > 0 THEN e / n::DOUBLE * ln(e / n::DOUBLE) ELSE 0 END) END AS entropy,
 density FROM z""", "entropy density")
def sign_entropy(spark, folder):
    s = ret_bars(spark, folder)
    s = s.add({"flip": F.when(F.signum("r") != R.lag(s, F.signum("r")), 1.0).when(F.col("r").isNull() | R.lag(s, "r").isNull(), None).otherwise(0.0)})
    return s.add({"entropy": R.sign_entropy(s, "r", 20), "density": R.reversal_density(s, "flip", 20)}).result("symbol", "bar", "entropy", "density")


@query("permutation_entropy", "E18", f"""WITH {_RET}, y AS (SELECT *, CASE WHEN lag(close, 2) OVER {_ORD} IS NULL THEN NULL ELSE
 (CASE WHEN lag(close, 2) OVER {_ORD} <= lag(close) OVER {_ORD} THEN 'a' ELSE 'b' END) || (CASE WHEN lag(close) OVER {_ORD} <= close THEN 'a' ELSE 'b' END) || (CASE WHEN lag(close, 2) OVER {_ORD} <= close THEN 'a' ELSE 'b' END) END AS k FROM x),
z AS (SELECT symbol, bar, list(k) FILTER (k IS NOT NULL) OVER {_W(17)} AS h FROM y),
v AS (SELECT symbol, bar, len(h) AS n, list_transform(list_distinct(h), lambda q: len(list_filter(h, lambda w: w = q)) / len(h)::DOUBLE) AS p FROM z)
SELECT symbol, bar, CASE WHEN n >= 2 THEN list_sum(list_transform(p, lambda q: -q * ln(q + 1e-12))) / ln(6) END AS pe FROM v""", "pe")
def permutation_entropy(spark, folder):
    s = ret_bars(spark, folder)
    s = s.add({"code": R.permutation_code(s, "close")})
    return s.add({"pe": R.permutation_entropy(s, "code", 20)}).result("symbol", "bar", "pe")


@query("fractal_dimensions", "E21 E22", f"""WITH {_RET}, y AS (SELECT symbol, bar, close, list(close) OVER w AS h, first_value(close) OVER w AS f, max(close) OVER w AS hi, min(close) OVER w AS lo,
 sum(abs(d)) OVER {_W(18)} AS path FROM x WINDOW w AS {_W(19)}),
z AS (SELECT *, len(h) AS n, abs(close - f) AS net, greatest(abs(hi - f), abs(lo - f)) AS far FROM y)
SELECT symbol, bar, CASE WHEN n >= 5 THEN CASE WHEN net <= 1e-12 OR path <= 1e-12 THEN 1 ELSE least(greatest(ln(n) / (ln(n) + ln(net / path + 1e-12)), 1), 2) END END AS fd,
 CASE WHEN n >= 5 THEN CASE WHEN far <= 1e-12 OR path <= 1e-12 THEN 1 ELSE least(greatest(log10(n) / (log10(far / path + 1e-12) + log10(n)), 1), 2) END END AS katz FROM z WHERE n = 20""", "fd katz")
def fractal_dimensions(spark, folder):
    s = ret_bars(spark, folder)
    s = s.add({"ad": F.abs("d"), "n": F.count("close").over(s.rows(-19, 0))})
    return s.add({"fd": R.fractal_dimension(s, "close", "ad", 20), "katz": R.katz_dimension(s, "close", "ad", 20)}).result().where("n = 20").select("symbol", "bar", "fd", "katz")


@query("weighted_averages", "E26 F6", f"""WITH {_RET}, y AS (SELECT symbol, bar, list(close) OVER {_W(8)} AS h9, list(close) OVER {_W(3)} AS h4 FROM x),
z AS (SELECT symbol, bar, CASE WHEN len(h9) >= 3 THEN list_sum(list_transform(h9, lambda v, i: v * (9 - len(h9) + i))) / (len(h9) * (9 - len(h9) + 1 + 9) / 2.0) END AS wma9,
 CASE WHEN len(h4) >= 2 THEN list_sum(list_transform(h4, lambda v, i: v * (4 - len(h4) + i))) / (len(h4) * (4 - len(h4) + 1 + 4) / 2.0) END AS wma4 FROM y),
u AS (SELECT symbol, bar, wma9, list(2 * wma4 - wma9) FILTER (wma9 IS NOT NULL AND wma4 IS NOT NULL) OVER {_W(2)} AS h3 FROM z)
SELECT symbol, bar, wma9, CASE WHEN len(h3) >= 2 THEN list_sum(list_transform(h3, lambda v, i: v * (3 - len(h3) + i))) / (len(h3) * (3 - len(h3) + 1 + 3) / 2.0) END AS hma9 FROM u""", "wma9 hma9")
def weighted_averages(spark, folder):
    s = ret_bars(spark, folder)
    s = s.add({"wma9": R.wma(s, "close", 9), "wma4": R.wma(s, "close", 4)}).add({"gap": 2 * F.col("wma4") - F.col("wma9")})
    return s.add({"hma9": R.wma(s, "gap", 3)}).result("symbol", "bar", "wma9", "hma9")


@query("window_drawdown", "E27", f"""WITH {_RET}, y AS (SELECT symbol, bar, list(close) OVER {_W(11)} AS h FROM x)
SELECT symbol, bar, list_min(list_transform(h, lambda v, i: v / list_max(h[1:i]) - 1)) AS mdd FROM y""", "mdd")
def window_drawdown(spark, folder):
    s = ret_bars(spark, folder)
    return s.add({"mdd": R.max_drawdown(s, "close", 12)}).result("symbol", "bar", "mdd")


@query("corrected_moments", "E28 E29", f"""WITH {_RET}, y AS (SELECT *, count(r) OVER w AS n FROM x WINDOW w AS {_W(29)})
SELECT symbol, bar, skewness(r) OVER w AS skew, kurtosis(r) OVER w AS kurt, avg(r) OVER w / nullif(stddev_samp(r) OVER w, 0) AS sharpe FROM y WINDOW w AS {_W(29)} QUALIFY n = 30""", "skew kurt sharpe")
def corrected_moments(spark, folder):
    s = ret_bars(spark, folder)
    d = s.add({"skew": R.skewness(s, "r", 30), "kurt": R.kurtosis(s, "r", 30), "sharpe": R.sharpe(s, "r", 30)})
    return d.result("symbol", "bar", "skew", "kurt", "sharpe").where(F.col("sharpe").isNotNull())


@query("side_volatility", "E30", f"""WITH {_RET} SELECT symbol, bar, CASE WHEN count(CASE WHEN r > 0 THEN r END) OVER w >= 2 AND count(CASE WHEN r < 0 THEN r END) OVER w >= 2
 THEN stddev_samp(CASE WHEN r > 0 THEN r END) OVER w / nullif(stddev_samp(CASE WHEN r < 0 THEN r END) OVER w, 0) END AS up_ratio FROM x WINDOW w AS {_W(19)}""", "up_ratio")
def side_volatility(spark, folder):
    s = ret_bars(spark, folder)
    return s.add({"up_ratio": R.side_vol_ratio(s, "r", 20)}).result("symbol", "bar", "up_ratio")


@query("rolling_vwap", "E32", f"WITH {_RET} SELECT symbol, bar, sum(close * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap FROM x WINDOW w AS {_W(11)}", "vwap")
def rolling_vwap(spark, folder):
    s = ret_bars(spark, folder)
    return s.add({"vwap": R.vwap(s, "close", "volume", 12)}).result("symbol", "bar", "vwap")


_MKT = f"""{PANEL}, x0 AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM panel),
x AS (SELECT *, avg(r) OVER (PARTITION BY day) AS m, median(r) OVER (PARTITION BY day) AS md FROM x0)"""
_PW = lambda n, hi="CURRENT ROW": f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {n} PRECEDING AND {hi})"


def market_panel(spark, folder, back):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=1, bound=DAYS)
    d = s.add({"r": R.pct_change(s, "close")}).result()
    from pyspark.sql import Window
    w = Window.partitionBy("day")
    d = d.withColumns({"m": F.avg("r").over(w), "md": F.percentile("r", F.lit(0.5)).over(w)})
    return sequence(d, ["symbol"], ["day"], back=back, bound=DAYS)


@query("market_beta", "E33 E34 G20", f"""WITH {_MKT} SELECT day, symbol, CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER w >= 20 THEN covar_samp(r, m) OVER w / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER w, 0) END AS beta,
 CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER w >= 20 THEN r - covar_samp(r, m) OVER w / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER w, 0) * m END AS resid FROM x WINDOW w AS {_PW(60, '1 PRECEDING')}""", "beta resid")
def market_beta(spark, folder):
    s = market_panel(spark, folder, 60)
    s = s.add({"beta": R.prior_beta(s, "r", "m", 60, 20)})
    return s.add({"resid": F.col("r") - F.col("beta") * F.col("m")}).result("day", "symbol", "beta", "resid")


@query("two_factor_betas", "E35 E36 I27", f"""WITH {_MKT}, a AS (SELECT x.day, x.symbol, x.r AS y, b.r AS f1, c.r AS f2 FROM x LEFT JOIN x b ON b.day = x.day AND b.symbol = 'P00' LEFT JOIN x c ON c.day = x.day AND c.symbol = 'P01' WHERE x.symbol NOT IN ('P00', 'P01')),
g AS (SELECT *, y IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AS ok FROM a),
s AS (SELECT *, count(*) FILTER (ok) OVER w AS n, sum(f1 * f1) FILTER (ok) OVER w AS aa, sum(f1 * f2) FILTER (ok) OVER w AS ab, sum(f2 * f2) FILTER (ok) OVER w AS bb, sum(f1 * y) FILTER (ok) OVER w AS p, sum(f2 * y) FILTER (ok) OVER w AS q FROM g WINDOW w AS {_PW(60, '1 PRECEDING')}),
b AS (SELECT *, CASE WHEN n >= 20 AND abs(aa * bb - ab * ab) > 1e-24 THEN (bb * p - ab * q) / (aa * bb - ab * ab) END AS b1, CASE WHEN n >= 20 AND abs(aa * bb - ab * ab) > 1e-24 THEN (aa * q - ab * p) / (aa * bb - ab * ab) END AS b2 FROM s)
SELECT day, symbol, b1, b2, y - first_value(b1) OVER m * f1 - first_value(b2) OVER m * f2 AS resid FROM b WINDOW m AS (PARTITION BY symbol, day // 30 ORDER BY day)""", "b1 b2 resid")
def two_factor_betas(spark, folder):
    from pyspark.sql import Window
    d = market_panel(spark, folder, 0).result("day", "symbol", "r")
    f1 = d.where("symbol = 'P00'").select("day", F.col("r").alias("f1"))
    f2 = d.where("symbol = 'P01'").select("day", F.col("r").alias("f2"))
    d = d.where(~F.col("symbol").isin("P00", "P01")).join(f1, "day", "left").join(f2, "day", "left")
    s = sequence(d, ["symbol"], ["day"], back=60, bound=DAYS)
    b1, b2 = R.two_factor_betas(s, "r", "f1", "f2", 60, 20)
    d = s.add({"b1": b1, "b2": b2}).result()
    w = Window.partitionBy("symbol", F.floor(F.col("day") / 30)).orderBy("day")
    return d.select("day", "symbol", "b1", "b2", (F.col("r") - F.first("b1").over(w) * F.col("f1") - F.first("b2").over(w) * F.col("f2")).alias("resid"))


@query("trailing_liquidity", "E37 E38 E39", f"""WITH {_MKT}, y AS (SELECT *, abs(r) / qv AS il FROM x) SELECT day, symbol, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret20, CASE WHEN count(qv) OVER i >= 20 THEN median(qv) OVER i END AS liq,
 CASE WHEN count(il) OVER p >= 15 THEN avg(il) OVER p * 1e6 END AS amihud, CAST(count(il) OVER p AS BIGINT) AS n_valid FROM y WINDOW i AS {_PW(19)}, p AS {_PW(20, '1 PRECEDING')}""", "ret20 liq amihud")
def trailing_liquidity(spark, folder):
    s = market_panel(spark, folder, 25)
    s = s.add({"il": F.abs("r") / F.col("qv")})
    return s.add({"ret20": R.pct_change(s, "close", 20), "liq": R.quantile(s, "qv", 20, 0.5), "amihud": R.prior(s, F.avg, "il", 20, 15) * 1e6,
                  "n_valid": F.count("il").over(s.rows(-20, -1))}).result("day", "symbol", "ret20", "liq", "amihud", "n_valid")


@query("volatility_regime", "E41", f"""WITH {_RET}, y AS (SELECT *, CASE WHEN count(r) OVER v >= 8 THEN stddev_samp(r) OVER v END AS vol FROM x WINDOW v AS {_W(23)}), z AS (SELECT symbol, bar, vol, list(vol) OVER {_W(99)} AS h FROM y),
p AS (SELECT symbol, bar, vol, 100 * len(list_filter(h, lambda q: q <= vol)) / len(list_filter(h, lambda q: q IS NOT NULL))::DOUBLE AS pct FROM z WHERE vol IS NOT NULL)
SELECT symbol, bar, pct, CASE WHEN pct < 33 THEN 'low' WHEN pct < 66 THEN 'mid' ELSE 'high' END AS regime FROM p""", "pct")
def volatility_regime(spark, folder):
    s = ret_bars(spark, folder, 130)
    s = s.add({"vol": R.std(s, "r", 24, 8)})
    got = F.collect_list("vol").over(s.rows(-99, 0))
    s = s.add({"pct": F.when(F.col("vol").isNotNull(), 100.0 * F.size(F.filter(got, lambda v: v <= F.col("vol"))) / F.size(got))})
    d = s.result("symbol", "bar", "pct").where(F.col("pct").isNotNull())
    return d.withColumn("regime", F.when(F.col("pct") < 33, "low").when(F.col("pct") < 66, "mid").otherwise("high"))


# --- recurrences ---------------------------------------------------------------------------------

_EMA = f"""WITH RECURSIVE {BARS}, x AS (SELECT symbol, bar, close, row_number() OVER {_ORD} AS i FROM bars),
e AS (SELECT symbol, bar, i, close, close AS e1, close AS e2, close AS e3 FROM x WHERE i = 1
 UNION ALL SELECT x.symbol, x.bar, x.i, x.close, e.e1 + (x.close - e.e1) * 2 / 13.0, e.e2 + ((e.e1 + (x.close - e.e1) * 2 / 13.0) - e.e2) * 2 / 13.0,
 e.e3 + ((e.e2 + ((e.e1 + (x.close - e.e1) * 2 / 13.0) - e.e2) * 2 / 13.0) - e.e3) * 2 / 13.0 FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)"""


@query("ema_family", "F1 F5 F9", _EMA + f""" SELECT symbol, bar, e1 AS ema, 2 * e1 - e2 AS dema, 3 * e1 - 3 * e2 + e3 AS tema, (e3 / lag(e3) OVER {_ORD} - 1) * 100 AS trix FROM e""", "ema dema tema trix")
def ema_family(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], back=K.warmup(12, 3), bound=HOURS)
    return K.kernel_pass(s, {"ema": (K.ema(12), ["close"]), "dema": (K.dema(12), ["close"]), "tema": (K.tema(12), ["close"]),
                             "trix": (K.trix(12), ["close"])}).result("symbol", "bar", "ema", "dema", "tema", "trix")


@query("ewma_volatility", "F11", f"""WITH RECURSIVE {BARS}, x AS (SELECT symbol, bar, power(ln(close / lag(close) OVER {_ORD}), 2) AS q, row_number() OVER {_ORD} AS i FROM bars),
e AS (SELECT symbol, bar, i, q AS e FROM x WHERE i = 2 UNION ALL SELECT x.symbol, x.bar, x.i, e.e + (x.q - e.e) * 2 / 61.0 FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)
SELECT x.symbol, x.bar, sqrt(e.e * {24 * 365}) AS vol FROM x LEFT JOIN e ON e.symbol = x.symbol AND e.i = x.i""", "vol")
def ewma_volatility(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], back=K.warmup(60), bound=HOURS)
    return K.kernel_pass(s, {"vol": (K.ewma_vol(60, 24 * 365), ["close"])}).result("symbol", "bar", "vol")


_HAR = lambda n, minp: f"CASE WHEN count(q) OVER {_W(n - 1)} >= {minp} THEN avg(q) OVER {_W(n - 1)} END"


@query("har_components", "H50", f"""WITH {_RET}, y AS (SELECT symbol, bar, r * r AS q FROM x), z AS (SELECT symbol, bar, q AS rv_1h, {_HAR(24, 12)} AS rv_1d, {_HAR(168, 84)} AS rv_1w FROM y)
SELECT *, sqrt(rv_1h * {24 * 365}) AS rv_1h_ann, sqrt(rv_1d * {24 * 365}) AS rv_1d_ann, sqrt(rv_1w * {24 * 365}) AS rv_1w_ann FROM z""", "rv_1h rv_1d rv_1w rv_1h_ann rv_1d_ann rv_1w_ann")
def har_components(spark, folder):
    s = ret_bars(spark, folder, back=168).add({"q": F.col("r") * F.col("r")})

    def mean(n, minp):
        w = s.rows(-(n - 1), 0)
        return F.when(F.count("q").over(w) >= minp, F.avg("q").over(w))

    d = s.add({"rv_1h": F.col("q"), "rv_1d": mean(24, 12), "rv_1w": mean(168, 84)}).result("symbol", "bar", "rv_1h", "rv_1d", "rv_1w")
    return d.withColumns({f"{c}_ann": F.sqrt(F.col(c) * (24 * 365)) for c in ("rv_1h", "rv_1d", "rv_1w")})


@query("wilder_rsi", "F2 F3", f"""WITH RECURSIVE {BARS}, x AS (SELECT symbol, bar, close - lag(close) OVER {_ORD} AS d, row_number() OVER {_ORD} AS i FROM bars),
e AS (SELECT symbol, bar, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM x WHERE i = 2
 UNION ALL SELECT x.symbol, x.bar, x.i, e.g + (greatest(x.d, 0) - e.g) / 14.0, e.l + (greatest(-x.d, 0) - e.l) / 14.0 FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)
SELECT symbol, bar, 100 - 100 / (1 + g / (l + 1e-12)) AS rsi FROM e UNION ALL SELECT symbol, bar, 0.0 FROM x WHERE i = 1""", "rsi")
def wilder_rsi(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], back=K.warmup(27), bound=HOURS)
    return K.kernel_pass(s, {"rsi": (K.rsi(14), ["close"])}).result("symbol", "bar", "rsi")


@query("kaufman_average", "F4", f"""WITH RECURSIVE {_RET}, y AS (SELECT symbol, bar, i, close, power(coalesce(abs(close - lag(close, 10) OVER {_ORD}) / (sum(abs(d)) OVER {_W(9)} + 1e-12), 0) * (2 / 3.0 - 2 / 31.0) + 2 / 31.0, 2) AS sc FROM x),
e AS (SELECT symbol, bar, i, close AS k FROM y WHERE i = 1 UNION ALL SELECT y.symbol, y.bar, y.i, e.k + y.sc * (y.close - e.k) FROM e JOIN y ON y.symbol = e.symbol AND y.i = e.i + 1)
SELECT symbol, bar, k AS kama FROM e""", "kama")
def kaufman_average(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], back=10_000, bound=HOURS)
    return K.kernel_pass(s, {"kama": (K.kama(10), ["close"])}).result("symbol", "bar", "kama")


_DM = f"""{BARS}, x0 AS (SELECT symbol, bar, high, low, close, high - lag(high) OVER {_ORD} AS up, lag(low) OVER {_ORD} - low AS dn, lag(close) OVER {_ORD} AS pc, row_number() OVER {_ORD} AS i FROM bars),
x AS (SELECT symbol, bar, i, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM x0)"""


@query("directional_index", "F7", f"""WITH RECURSIVE {_DM}, e AS (SELECT symbol, bar, i, p, m, tr FROM x WHERE i = 1
 UNION ALL SELECT x.symbol, x.bar, x.i, e.p + (x.p - e.p) / 14.0, e.m + (x.m - e.m) / 14.0, e.tr + (x.tr - e.tr) / 14.0 FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1),
f AS (SELECT symbol, bar, i, 100 * p / (tr + 1e-12) AS plus_di, 100 * m / (tr + 1e-12) AS minus_di FROM e), g AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-12) AS dx FROM f),
h AS (SELECT symbol, bar, i, dx AS adx FROM g WHERE i = 1 UNION ALL SELECT g.symbol, g.bar, g.i, h.adx + (g.dx - h.adx) / 14.0 FROM h JOIN g ON g.symbol = h.symbol AND g.i = h.i + 1)
SELECT g.symbol, g.bar, g.plus_di, g.minus_di, h.adx FROM g JOIN h ON h.symbol = g.symbol AND h.i = g.i""", "plus_di minus_di adx", digits=5)
def directional_index(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "high", "low", "close"), ["symbol"], ["bar"], back=K.warmup(27, 2), bound=HOURS)
    hlc = ["high", "low", "close"]
    return K.kernel_pass(s, {"plus_di": (K.directional(14, "plus"), hlc), "minus_di": (K.directional(14, "minus"), hlc),
                             "adx": (K.directional(14, "adx"), hlc)}).result("symbol", "bar", "plus_di", "minus_di", "adx")


@query("complexity_kernels", "E16 E19 E20 E23 E24 E25 H23 F8")
def complexity_kernels(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], back=K.warmup(40, 2), bound=HOURS)
    k = {"entropy": K.histogram_entropy(20), "hurst": K.hurst(30), "hurst_rs": K.rescaled_range(30), "cycle": K.spectrum(32, "cycle"),
         "fft_1": K.spectrum(32, "component", 1), "spectral": K.spectrum(32, "entropy"), "tsi": K.tsi(14)}
    return K.kernel_pass(s, {n: (f, ["close"]) for n, f in k.items()}).result("symbol", "bar", *k)


@query("volume_indices", "F10", f"""WITH {_RET}, y AS (SELECT *, close / lag(close) OVER {_ORD} AS g, volume - lag(volume) OVER {_ORD} AS dv FROM x)
SELECT symbol, bar, sum(CASE WHEN dv < 0 THEN ln(g) ELSE 0 END) OVER {_ORD} AS log_nvi, sum(CASE WHEN dv > 0 THEN ln(g) ELSE 0 END) OVER {_ORD} AS log_pvi FROM y""", "log_nvi log_pvi")
def volume_indices(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close", "volume"), ["symbol"], ["bar"], back=1, bound=HOURS)
    d = s.add({"g": F.ln(F.col("close") / R.lag(s, "close")), "dv": R.change(s, "volume")}).result()
    d = running_total(d, ["symbol"], ["bar"], {"a": F.when(F.col("dv") < 0, F.col("g")).otherwise(0.0), "b": F.when(F.col("dv") > 0, F.col("g")).otherwise(0.0)}, 60 * DAY_US)
    return d.select("symbol", "bar", F.col("a").alias("log_nvi"), F.col("b").alias("log_pvi"))


@query("true_runs", "F12 F14", f"""WITH {_RET}, y AS (SELECT symbol, bar, close, i, coalesce(r > 0, false) AS up, close < max(close) OVER {_ORD} AS under FROM x)
SELECT symbol, bar, i - coalesce(max(CASE WHEN NOT up THEN i END) OVER {_ORD}, 0) AS up_run, i - coalesce(max(CASE WHEN NOT under THEN i END) OVER {_ORD}, 0) AS under_run FROM y""")
def true_runs(spark, folder):
    from tidemark.operators.recurrence import running_peak
    s = ret_bars(spark, folder, 1)
    d = running_peak(s.result("symbol", "bar", "close", "r"), ["symbol"], ["bar"], "close", "peak", 60 * DAY_US)
    d = K.add_run_lengths(d, ["symbol"], ["bar"], {"up_run": F.col("r") > 0, "under_run": F.col("close") < F.col("peak")}, 60 * DAY_US)
    return d.select("symbol", "bar", "up_run", "under_run")


@query("sign_runs", "F13", f"""WITH {_RET}, y AS (SELECT symbol, bar, i, sign(coalesce(r, 0)) AS s FROM x), z AS (SELECT *, s <> 0 AND s = lag(s) OVER {_ORD} AS same FROM y)
SELECT symbol, bar, CASE WHEN s = 0 THEN 0 ELSE i - coalesce(max(CASE WHEN NOT coalesce(same, false) THEN i END) OVER {_ORD}, 0) + 1 END AS run FROM z""")
def sign_runs(spark, folder):
    d = ret_bars(spark, folder, 1).result("symbol", "bar", "r")
    return K.sign_run(d, ["symbol"], ["bar"], "r", "run", 60 * DAY_US).select("symbol", "bar", "run")


@query("expanding_hour_mean", "F15", f"""WITH {_RET} SELECT symbol, bar, coalesce(avg(volume) OVER (PARTITION BY symbol, bar // {HOUR_US} % 24 ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(volume) OVER {_ORD}) AS profile FROM x""", "profile")
def expanding_hour_mean(spark, folder):
    d = bars(spark, folder).withColumn("hour", F.floor(F.col("bar") / HOUR_US) % 24).select("symbol", "bar", "hour", "volume")
    one = F.lit(1)
    d = running_total(d, ["symbol", "hour"], ["bar"], {"hs": F.col("volume"), "hn": one}, 60 * DAY_US)
    d = running_total(d, ["symbol"], ["bar"], {"ss": F.col("volume"), "sn": one}, 60 * DAY_US)
    before = div(F.col("hs") - F.col("volume"), F.col("hn") - 1)
    return d.select("symbol", "bar", F.coalesce(before, F.col("ss") / F.col("sn")).alias("profile"))


@query("hysteresis_state", "F16", f"""WITH {_RET}, y AS (SELECT symbol, bar, r, sum(CASE WHEN abs(r) < 0.5 THEN 1 ELSE 0 END) OVER {_ORD} AS isle FROM x)
SELECT symbol, bar, coalesce(first_value(CASE WHEN abs(r) >= 1.0 THEN sign(r) END IGNORE NULLS) OVER (PARTITION BY symbol, isle ORDER BY bar), 0) AS state FROM y""", "state")
def hysteresis_state(spark, folder):
    d = ret_bars(spark, folder, 1).result("symbol", "bar", "r")
    return K.hysteresis(d, ["symbol"], ["bar"], "r", "state", 1.0, 0.5, 60 * DAY_US).select("symbol", "bar", "state")


@query("confirmed_regime", "F17", f"""WITH {_RET}, y AS (SELECT symbol, bar, i, CASE WHEN abs(r) > 1 THEN 'wild' ELSE 'calm' END AS t FROM x), z AS (SELECT *, coalesce(t = lag(t) OVER {_ORD}, false) AS same FROM y),
u AS (SELECT *, i - coalesce(max(CASE WHEN NOT same THEN i END) OVER {_ORD}, 0) AS run FROM z)
SELECT symbol, bar, coalesce(last_value(CASE WHEN run = 2 THEN t END IGNORE NULLS) OVER {_ORD}, 'calm') AS state FROM u""")
def confirmed_regime(spark, folder):
    d = ret_bars(spark, folder, 1).result("symbol", "bar", "r").withColumn("t", F.when(F.abs("r") > 1, "wild").otherwise("calm"))
    return K.confirmed_state(d, ["symbol"], ["bar"], "t", "state", 3, 60 * DAY_US, "calm").select("symbol", "bar", "state")


@query("rolling_arrays", "F23 F24", f"""WITH {_RET}, y AS (SELECT symbol, bar, list(close) OVER {_W(4)} AS h, list([open, close]) OVER {_W(2)} AS m FROM x)
SELECT symbol, bar, list_concat(list_transform(range(5 - len(h)), lambda q: 0.0), h) AS last5, len(m) AS got, list_sum(flatten(m)) AS mass FROM y""", "mass")
def rolling_arrays(spark, folder):
    s = ret_bars(spark, folder)
    s = s.add({"last5": R.padded_list(s, "close", 5), "m": R.padded_matrix(s, ["open", "close"], 3), "got": F.count(F.lit(1)).over(s.rows(-2, 0))})
    total = F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, v: a + v)
    return s.result("symbol", "bar", "last5", F.col("got"), total.alias("mass"))
