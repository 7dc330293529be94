"""Votes, crosses, cadences, folds by month, retention and checks of weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import ind
from tidemark.operators import recurrence as K
from tidemark.operators import regimes as G
from tidemark.operators import rolling as R
from tidemark.operators.blocks import DAYS, HOURS, sequence
from tidemark.operators.crosssection import all_present_least, centred_rank, first_rank, over
from tidemark.operators.resample import HOUR_US
from tidemark.plans.names import _XR
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, TICKS, bars, decisions, panel, read, ticks
from tidemark.plans.windows import _MKT, _PW, market_panel

_O = "(PARTITION BY symbol ORDER BY bar)"
_EWM = lambda n: f"list_reduce(cl, lambda a, b: a + (b - a) * 2 / {n + 1}.0)"
_TREND = f"""{BARS}, e0 AS (SELECT symbol, bar, close, high, low, lag(close) OVER {_O} AS pc, list(close) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS cl FROM bars),
e1 AS (SELECT *, close / {_EWM(200)} - 1 AS dist, {_EWM(50)} / {_EWM(200)} - 1 AS spread, ln(close / lag(close, 72) OVER {_O}) AS m3, ln(close / lag(close, 240) OVER {_O}) AS m30, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM e0)"""


def trend_bars(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "open", "high", "low", "close"), ["symbol"], ["bar"], back=2 * K.warmup(200), bound=HOURS)
    s = K.kernel_pass(s, {"e50": (K.ema(50), ["close"]), "e200": (K.ema(200), ["close"]), "atr": (K.atr(27), ["high", "low", "close"])})
    return s.add({"dist": F.col("close") / F.col("e200") - 1, "spread": F.col("e50") / F.col("e200") - 1, "m3": F.ln(F.col("close") / R.lag(s, "close", 72)), "m30": F.ln(F.col("close") / R.lag(s, "close", 240))})


_VOTE = lambda x: f"CASE WHEN count(*) OVER v >= 12 THEN avg(CASE WHEN {x} THEN 1.0 ELSE 0 END) OVER v END"


@query("macro_vote", "F18", f"""WITH {_TREND}, q AS (SELECT symbol, bar, {_VOTE('dist < -0.02 AND (coalesce(m3, 0) < -0.05 OR coalesce(m30, 0) < -0.15)')} AS bear, {_VOTE('dist > 0 AND spread > 0 AND coalesce(m3, 0) > 0.03')} AS bull FROM e1 WINDOW v AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING))
SELECT symbol, bar, CASE WHEN bear > 0.6 THEN 'BEAR' WHEN bull > 0.6 THEN 'BULL' ELSE 'NEUTRAL' END AS regime FROM q""")
def macro_vote(spark, folder):
    s = trend_bars(spark, folder)
    m3, m30 = F.coalesce("m3", F.lit(0.0)), F.coalesce("m30", F.lit(0.0))
    bear, bull = (F.col("dist") < -0.02) & ((m3 < -0.05) | (m30 < -0.15)), (F.col("dist") > 0) & (F.col("spread") > 0) & (m3 > 0.03)
    return s.add({"regime": G.majority_vote(s, bear, bull)}).result("symbol", "bar", "regime")


@query("cross_events", "H40", f"""WITH {_TREND}, i AS (SELECT *, row_number() OVER {_O} - 1 AS i, list_reduce(list(tr) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), lambda a, b: a + (b - a) / 14.0) AS atr FROM e1), x AS (SELECT *, CASE WHEN spread > 0 AND lag(spread) OVER {_O} <= 0 THEN i END AS hit FROM i),
l AS (SELECT *, max(hit) OVER {_O} AS last FROM x), d AS (SELECT *, CASE WHEN spread > 0 THEN i - last END AS days FROM l)
SELECT symbol, bar, coalesce(days, 0)::DOUBLE AS days_since_golden_cross, CASE WHEN days <= 168 THEN 1.0 ELSE 0 END AS gc_fresh, coalesce(least(greatest(dist * close / CASE WHEN atr > 0 THEN atr ELSE close * 0.01 END, -15), 15), 0) AS dist_ema200_atr FROM d""", "days_since_golden_cross gc_fresh dist_ema200_atr", digits=5)
def cross_events(spark, folder):
    d = trend_bars(spark, folder).result("symbol", "bar", "spread", G.atr_distance(F.col("dist"), F.col("close"), F.col("atr")).alias("dist_ema200_atr"))
    return G.since_cross(d, ["symbol"], ["bar"], "spread", HOUR_US * 10_000).drop("spread")


@query("cadence_regimes", "K37", f"""WITH {TICKS}, t AS (SELECT DISTINCT symbol, ts_us FROM ticks WHERE kind = 'error'), g AS (SELECT symbol, ts_us, lead(ts_us) OVER w AS nx FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_us)),
c AS (SELECT *, CAST(round_even((nx - ts_us) / {4 * HOUR_US}.0, 0) AS BIGINT) AS cadence FROM g WHERE nx IS NOT NULL), n AS (SELECT *, CASE WHEN cadence = lag(cadence) OVER w THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts_us)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts_us) AS isle FROM n)
SELECT symbol, min(ts_us) AS start, max(nx) AS "end", any_value(cadence) AS cadence, count(*) + 1 AS n FROM k GROUP BY symbol, isle""")
def cadence_regimes(spark, folder):
    t = ticks(spark, folder).where("kind = 'error'").select("symbol", "ts_us").distinct()
    return G.cadence_regimes(t, ["symbol"], "ts_us", 4 * HOUR_US, 30 * DAY_US)


@query("month_folds", "N41", """WITH o AS (SELECT o_orderdate AS ts, o_totalprice AS x FROM orders), m AS (SELECT DISTINCT date_trunc('month', ts)::DATE + to_months(k::INT) AS s FROM o, (SELECT unnest(range(31)) AS k)),
b AS (SELECT s::DATE AS s, epoch_us(s::TIMESTAMP) AS t0, epoch_us((s::DATE - 120)::TIMESTAMP) AS c0, epoch_us(((s::DATE - 120) - to_months(24))::TIMESTAMP) AS f0, epoch_us(s::TIMESTAMP) - 8 * 3600000000 AS e0, epoch_us((s + to_months(1))::TIMESTAMP) AS t1 FROM m),
r AS (SELECT strftime(s, '%Y-%m') AS test_month, x, CASE WHEN epoch_us(ts) >= t0 AND epoch_us(ts) < t1 THEN 'test' WHEN epoch_us(ts) >= f0 AND epoch_us(ts) < c0 THEN 'fit' WHEN epoch_us(ts) >= c0 AND epoch_us(ts) < c0 + (e0 - c0) // 2 THEN 'calib_fit' WHEN epoch_us(ts) >= c0 + (e0 - c0) // 2 AND epoch_us(ts) < e0 THEN 'calib_select' END AS role FROM o JOIN b ON epoch_us(ts) >= f0 AND epoch_us(ts) < t1)
SELECT test_month, role, count(*) AS n, avg(x) AS mean FROM r WHERE role IS NOT NULL GROUP BY 1, 2""", "mean", digits=3)
def month_folds(spark, folder):
    o = read(spark, folder, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("x"))
    return G.month_folds(o, "ts").groupBy("test_month", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


_HALF = 824_000_000_000_000
_BASIS = "CASE ascii(right(symbol, 1)) % 3 WHEN 0 THEN 'ABSOLUTE' WHEN 1 THEN 'EXCESS_VS_BASELINE' END"


@query("edge_retention", "N61", f"""WITH {DECISIONS}, d AS (SELECT symbol, ts_us < {_HALF} AS past, gross_bps, gross_bps - avg(gross_bps) OVER (PARTITION BY ts_us // {DAY_US}) AS ex FROM decisions),
a AS (SELECT symbol, {_BASIS} AS basis, avg(gross_bps) FILTER (past) AS expected, avg(gross_bps) FILTER (NOT past) AS gross, avg(ex) FILTER (NOT past) AS excess FROM d GROUP BY 1, 2)
SELECT symbol, basis, expected, gross, excess, CASE WHEN expected > 0 THEN round(CASE basis WHEN 'ABSOLUTE' THEN gross WHEN 'EXCESS_VS_BASELINE' THEN excess END / expected, 3) END AS retention FROM a""", "expected gross excess retention", digits=5)
def edge_retention(spark, folder):
    d = decisions(spark, folder)
    day = d.groupBy(F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(F.avg("gross_bps").alias("all"))
    d = d.withColumn("day", F.floor(F.col("ts_us") / DAY_US)).join(day, "day")
    code = F.ascii(F.right("symbol", F.lit(1))) % 3
    basis = F.when(code == 0, "ABSOLUTE").when(code == 1, "EXCESS_VS_BASELINE")
    past, x = F.col("ts_us") < _HALF, F.col("gross_bps")
    a = d.groupBy("symbol", basis.alias("basis")).agg(F.avg(F.when(past, x)).alias("expected"), F.avg(F.when(~past, x)).alias("gross"), F.avg(F.when(~past, x - F.col("all"))).alias("excess"))
    return a.withColumn("retention", G.edge_retention(F.col("expected"), F.col("basis"), F.col("gross"), F.col("excess")))


@query("weight_invariants", "O9", f"""WITH {_MKT}, b AS (SELECT day, symbol, r, m, fund, covar_samp(r, m) OVER w / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER w, 0) AS beta, count(r) OVER w AS n FROM x WINDOW w AS {_PW(60, '1 PRECEDING')}),
l AS (SELECT *, count(*) OVER (PARTITION BY day) AS k, row_number() OVER (PARTITION BY day ORDER BY fund, symbol) AS p FROM b WHERE n >= 20 AND r IS NOT NULL), w AS (SELECT *, CASE WHEN p <= 3 THEN 1 / 3.0 WHEN p > k - 3 THEN CASE WHEN day % 11 = 0 THEN -1 / 2.0 ELSE -1 / 3.0 END ELSE 0 END AS wt FROM l WHERE k >= 8),
d AS (SELECT day, sum(abs(wt)) AS gross, max(abs(wt)) AS top, sum(wt) AS net, sum(wt * coalesce(beta, 0)) + CASE WHEN day % 5 > 0 THEN -sum(wt * beta) ELSE 0 END AS beta, sum(wt * r) AS ret FROM w GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (gross > 2 + 1e-6) AS gross_leg_exceeds_2, count(*) FILTER (top > 0.4 + 1e-9) AS per_name_cap_violated, count(*) FILTER (abs(net) > 1e-6) AS long_short_not_dollar_neutral, count(*) FILTER (abs(beta) > 0.05) AS portfolio_beta_not_neutral, count(*) FILTER (ret <= -1) AS daily_return_leq_minus_100pct FROM d""")
def weight_invariants(spark, folder):
    """Weights that break the rules on some days: too short on every eleventh, without a hedge on every fifth."""
    s = market_panel(spark, folder, 60)
    d = s.add({"beta": R.prior_beta(s, "r", "m", 60, 1), "n": F.count("r").over(s.rows(-60, -1))}).result().where("n >= 20 and r is not null")
    d = d.withColumns({"k": over(["day"], F.count(F.lit(1))), "p": first_rank("fund", "symbol", "day")}).where("k >= 8")
    d = d.withColumn("wt", F.when(F.col("p") <= 3, 1 / 3.0).when(F.col("p") > F.col("k") - 3, F.when(F.col("day") % 11 == 0, -0.5).otherwise(-1 / 3.0)).otherwise(0.0))
    d = d.withColumns({"hedge": F.when(F.col("day") % 5 > 0, -over(["day"], F.sum(F.col("wt") * F.col("beta")))).otherwise(0.0), "ret": over(["day"], F.sum(F.col("wt") * F.col("r")))})
    return G.weight_violations(d, "day", "wt", "beta", "hedge", "ret", 0.4)


_SY = "(PARTITION BY symbol ORDER BY day)"
_R = lambda n: f"(PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING)"


@query("squeeze_signals", "I15", f"""WITH {_MKT}, y AS (SELECT day, symbol, r, ratio, oi / lag(oi, 5) OVER {_SY} - 1 AS d5, oi / lag(oi) OVER {_SY} - 1 AS d1, CASE WHEN count(r) OVER {_R(3)} = 3 THEN round(sum(r) OVER {_R(3)}, 12) END AS r3, CASE WHEN count(r) OVER {_R(20)} = 20 THEN stddev_samp(r) OVER {_R(20)} END AS vol FROM x),
k AS (SELECT *, {_XR('ratio')} AS ga, -({_XR('d5')}) AS drain, {_XR('r3')} AS up, CASE WHEN coalesce(abs(r) > 2 * vol AND d1 < -0.02, false) THEN 1.0 ELSE 0 END AS purge FROM y)
SELECT day, symbol, CASE WHEN ga IS NOT NULL AND drain IS NOT NULL AND up IS NOT NULL THEN least(-ga, drain, up) END AS squeeze_setup, CASE WHEN ga IS NOT NULL AND drain IS NOT NULL AND up IS NOT NULL THEN least(ga, drain, -up) END AS long_capit, CASE WHEN count(*) OVER {_R(10)} = 10 THEN avg(purge) OVER {_R(10)} END AS stress_purge_10 FROM k""", "squeeze_setup long_capit stress_purge_10")
def squeeze_signals(spark, folder):
    s = market_panel(spark, folder, 34)
    w10 = s.rows(-9, 0)
    s = s.add({"d5": R.pct_change(s, "oi", 5), "d1": R.pct_change(s, "oi"), "r3": F.round(R.total(s, "r", 3), 12), "vol": R.std(s, "r", 20)})
    s = s.add({"purge": ind(F.coalesce((F.abs("r") > 2 * F.col("vol")) & (F.col("d1") < -0.02), F.lit(False)))})
    d = s.add({"stress_purge_10": F.when(F.count(F.lit(1)).over(w10) == 10, F.avg("purge").over(w10))}).result("day", "symbol", "ratio", "d5", "r3", "stress_purge_10")
    d = d.withColumns({"ga": centred_rank("ratio", "day"), "drain": -centred_rank("d5", "day"), "up": centred_rank("r3", "day")})
    return d.select("day", "symbol", all_present_least(-F.col("ga"), F.col("drain"), F.col("up")).alias("squeeze_setup"), all_present_least(F.col("ga"), F.col("drain"), -F.col("up")).alias("long_capit"), "stress_purge_10")
