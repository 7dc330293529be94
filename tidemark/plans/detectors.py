"""Event detectors, regimes and screens over the daily panel and the bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import div, flag, ind
from tidemark.operators import detectors as X
from tidemark.operators import rolling as R
from tidemark.operators.asof import asof_join
from tidemark.operators.blocks import DAYS, sequence
from tidemark.operators.crosssection import exact_quantiles
from tidemark.operators.events import FLOW_RANK, OI_DROP, SHOCK, cooldown, forced_flow, other_names_within, trailing_counts, zone
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, bars, decisions, panel
from tidemark.plans.windows import _MKT, _ORD, _PW, _RET, _W, market_panel, ret_bars

_SYM = "(PARTITION BY symbol ORDER BY day)"


def _kept(body: str, gap: int, clock: str = "day") -> str:
    """SQL of a keep-first cooldown: ``body`` ends with a table t(symbol, clock, ...)."""
    return f"""WITH RECURSIVE {body}, k AS (SELECT symbol, min({clock}) AS {clock} FROM t GROUP BY symbol UNION ALL
 SELECT k.symbol, (SELECT min(t.{clock}) FROM t WHERE t.symbol = k.symbol AND t.{clock} >= k.{clock} + {gap}) FROM k WHERE k.{clock} IS NOT NULL)
SELECT t.* FROM t JOIN k ON k.symbol = t.symbol AND k.{clock} = t.{clock}"""


_DERIV = f"""{_MKT}, y AS (SELECT day, symbol, r, r - m AS resid, fund, close, qv, 2 * tbq / qv - 1 AS flow, oi / lag(oi) OVER {_SYM} - 1 AS doi, close / spot - 1 AS basis, low, high,
 CASE WHEN count(r - m) OVER p = 20 THEN stddev_samp(r - m) OVER p END AS sd, list(qv) OVER p AS hq, list(tbq / qv) OVER p AS hf FROM x WINDOW p AS {_PW(20, '1 PRECEDING')}),
z AS (SELECT *, CASE WHEN len(hq) = 20 THEN len(list_filter(hq, lambda q: q <= qv)) / 20.0 END AS vrank, CASE WHEN len(hf) = 20 THEN len(list_filter(hf, lambda q: q <= tbq)) / 20.0 END AS frank FROM (SELECT *, (flow + 1) / 2 AS tbq FROM y))"""


def derivative_panel(spark, folder):
    s = market_panel(spark, folder, 22)
    s = s.add({"resid": F.col("r") - F.col("m"), "flow": 2 * F.col("tbq") / F.col("qv") - 1, "tb": F.col("tbq") / F.col("qv"),
               "doi": R.pct_change(s, "oi"), "basis": F.col("close") / F.col("spot") - 1})
    return s.add({"sd": R.prior(s, F.stddev_samp, "resid", 20), "vrank": R.prior_rank_share(s, "qv", 20)}).result()


@query("deleveraging", "K24", _kept(_DERIV + """, t AS (SELECT symbol, day, resid, doi FROM z WHERE resid <= -1.0 * sd AND doi <= -0.03 AND vrank >= 0.2)""", 5), "resid doi")
def deleveraging(spark, folder):
    d = derivative_panel(spark, folder).where("resid <= -1.0 * sd and doi <= -0.03 and vrank >= 0.2").select("symbol", "day", "resid", "doi")
    return cooldown(d, ["symbol"], "day", 5)


@query("crowding", "", _kept(_DERIV + """, t AS (SELECT symbol, day, fund, basis FROM z WHERE fund >= 0.02 AND abs(basis) >= 0.2 AND doi >= 0.03 AND sign(round(flow, 9)) = sign(fund))""", 3), "fund basis")
def crowding(spark, folder):
    d = derivative_panel(spark, folder).where("fund >= 0.02 and abs(basis) >= 0.2 and doi >= 0.03 and sign(round(flow, 9)) = sign(fund)").select("symbol", "day", "fund", "basis")
    return cooldown(d, ["symbol"], "day", 3)


@query("forced_flow_reversal", "", _kept(_DERIV + """, t AS (SELECT symbol, day, resid, vrank FROM z WHERE vrank >= 0.9 AND doi <= -0.05 AND abs(resid) >= 1.0 * sd)""", 5), "resid vrank")
def forced_flow_reversal(spark, folder):
    """A looser screen on total volume; K5 with the thresholds of the original is ``forced_flow_events``."""
    d = derivative_panel(spark, folder).where("vrank >= 0.9 and doi <= -0.05 and abs(resid) >= 1.0 * sd").select("symbol", "day", "resid", "vrank")
    return cooldown(d, ["symbol"], "day", 5)


_FORCED = f"""{_MKT}, y AS (SELECT day, symbol, r - m AS resid, abs(2 * tbq - qv) AS fl, oi / lag(oi) OVER {_SYM} - 1 AS doi, list(abs(2 * tbq - qv)) OVER p AS hf, CASE WHEN count(r - m) OVER p = 30 THEN stddev_samp(r - m) OVER p END AS sd FROM x WINDOW p AS {_PW(30, '1 PRECEDING')}),
z AS (SELECT *, CASE WHEN len(hf) = 30 THEN len(list_filter(hf, lambda q: q <= fl)) / 30.0 END AS flow_rank FROM y)"""


@query("forced_flow_events", "K5", _kept(_FORCED + f""", t AS (SELECT symbol, day, resid, flow_rank FROM z WHERE flow_rank >= {FLOW_RANK} AND doi <= {OI_DROP} AND abs(resid) >= {SHOCK} * sd)""", 5), "resid flow_rank")
def forced_flow_events(spark, folder):
    s = market_panel(spark, folder, 32)
    s = s.add({"resid": F.col("r") - F.col("m"), "signed": 2 * F.col("tbq") - F.col("qv"), "doi": R.pct_change(s, "oi")})
    d = forced_flow(s, "signed", "doi", "resid", 30).result("symbol", "day", "resid", "flow_rank", "forced_flow")
    return cooldown(d.where("forced_flow").drop("forced_flow"), ["symbol"], "day", 5)


_OIZ = f"""{_MKT}, y AS (SELECT *, oi / lag(oi, 3) OVER {_SYM} - 1 AS d3, close / lag(close, 3) OVER {_SYM} - 1 AS p3, ratio2 AS tt, 2 * tbq / qv - 1 AS tk, 1e4 * (close / spot - 1) AS prem FROM x),
z AS (SELECT *, CASE WHEN count(d3) OVER p >= 20 THEN (d3 - avg(d3) OVER p) / nullif(stddev_samp(d3) OVER p, 0) END AS zd, CASE WHEN count(tt) OVER p >= 20 THEN (tt - avg(tt) OVER p) / nullif(stddev_samp(tt) OVER p, 0) END AS zt,
 CASE WHEN count(tk) OVER p >= 20 THEN (tk - avg(tk) OVER p) / nullif(stddev_samp(tk) OVER p, 0) END AS zk, CASE WHEN count(prem) OVER p >= 20 THEN (prem - avg(prem) OVER p) / nullif(stddev_samp(prem) OVER p, 0) END AS zp FROM y WINDOW p AS {_PW(30, '1 PRECEDING')})"""


def oi_scores(spark, folder):
    s = market_panel(spark, folder, 34)
    s = s.add({"d3": R.pct_change(s, "oi", 3), "p3": R.pct_change(s, "close", 3), "tk": 2 * F.col("tbq") / F.col("qv") - 1, "prem": 1e4 * (F.col("close") / F.col("spot") - 1)})
    return s.add({"zd": R.prior_z(s, "d3", 30, 20), "zt": R.prior_z(s, "ratio2", 30, 20), "zk": R.prior_z(s, "tk", 30, 20), "zp": R.prior_z(s, "prem", 30, 20)}).result()


@query("oi_cascade", "K6", _kept(_OIZ + """, t AS (SELECT symbol, day, CASE WHEN p3 < 0 THEN 'LONG_CASCADE' ELSE 'SHORT_SQUEEZE' END AS kind, zd, p3 FROM z WHERE zd <= -0.5 AND abs(p3) >= 0.2)""", 4), "zd p3")
def oi_cascade(spark, folder):
    d = oi_scores(spark, folder).where("zd <= -0.5 and abs(p3) >= 0.2")
    d = d.select("symbol", "day", F.when(F.col("p3") < 0, "LONG_CASCADE").otherwise("SHORT_SQUEEZE").alias("kind"), "zd", "p3")
    return cooldown(d, ["symbol"], "day", 4)


@query("crowd_washout", "K7", _kept(_OIZ + ", t AS (SELECT symbol, day, zt, d3 FROM z WHERE zt <= -1.2 AND d3 <= -0.05)", 4), "zt d3")
def crowd_washout(spark, folder):
    return cooldown(oi_scores(spark, folder).where("zt <= -1.2 and d3 <= -0.05").select("symbol", "day", "zt", "d3"), ["symbol"], "day", 4)


@query("flow_ignition", "", _kept(_OIZ + ", t AS (SELECT symbol, day, zd, zk, r FROM z WHERE zd >= 1.0 AND zk >= 0.5 AND r >= 0.003)", 4), "zd zk r")
def flow_ignition(spark, folder):
    return cooldown(oi_scores(spark, folder).where("zd >= 1.0 and zk >= 0.5 and r >= 0.003").select("symbol", "day", "zd", "zk", "r"), ["symbol"], "day", 4)


@query("premium_dislocation", "K9", _kept(_OIZ + ", t AS (SELECT symbol, day, CASE WHEN zp < 0 THEN 'PANIC' ELSE 'FOMO' END AS kind, zp, prem FROM z WHERE abs(zp) >= 2 AND abs(prem) >= 10 AND sign(zp) = sign(prem))", 4), "zp prem", digits=3)
def premium_dislocation(spark, folder):
    d = oi_scores(spark, folder).where("abs(zp) >= 2 and abs(prem) >= 10 and sign(zp) = sign(prem)")
    return cooldown(d.select("symbol", "day", F.when(F.col("zp") < 0, "PANIC").otherwise("FOMO").alias("kind"), "zp", "prem"), ["symbol"], "day", 4)


@query("leader_spillover", "K10", _kept(f"""{_RET}, ld AS (SELECT bar, r AS lr FROM x WHERE symbol = 'S00' AND r IS NOT NULL), j AS (SELECT x.symbol, x.bar, x.r, ld.lr, ld.bar AS lb FROM x ASOF LEFT JOIN ld ON x.bar >= ld.bar WHERE x.symbol <> 'S00'),
 t AS (SELECT symbol, bar, r, lr FROM j WHERE bar - lb <= {2 * HOUR_US} AND abs(lr) >= 1.0 AND sign(lr) * r <= 0.4 * abs(lr))""", 6 * HOUR_US, "bar"), "r lr")
def leader_spillover(spark, folder):
    d = ret_bars(spark, folder, 1).result("symbol", "bar", "r")
    lead = d.where("symbol = 'S00' and r is not null").select("bar", F.col("r").alias("lr"))
    d = asof_join(d.where("symbol <> 'S00'"), lead, by=[], left_clock="bar", right_clock="bar", cols=["lr"], prefix="l_", tolerance=2 * HOUR_US)
    d = d.withColumnRenamed("l_lr", "lr").where("abs(lr) >= 1.0 and sign(lr) * r <= 0.4 * abs(lr)").select("symbol", "bar", "r", "lr")
    return cooldown(d, ["symbol"], "bar", 6 * HOUR_US)


@query("far_from_low", "", f"WITH {_RET} SELECT symbol, bar, close / min(low) OVER w - 1 AS dist FROM x WINDOW w AS {_W(23)} QUALIFY close / min(low) OVER w - 1 >= 5", "dist")
def far_from_low(spark, folder):
    s = ret_bars(spark, folder, 24)
    return s.add({"dist": F.col("close") / F.min("low").over(s.rows(-23, 0)) - 1}).result("symbol", "bar", "dist").where("dist >= 5")


_REG = f"""{PANEL}, q AS (SELECT symbol, quantile_cont(fund, 0.8) AS hi, quantile_cont(fund, 0.2) AS lo FROM panel WHERE day < 10500 GROUP BY 1), g AS (SELECT p.symbol, p.day, CASE WHEN fund >= hi THEN 'RICH' WHEN fund <= lo THEN 'CHEAP' ELSE 'NONE' END AS regime FROM panel p JOIN q ON q.symbol = p.symbol),
st AS (SELECT *, coalesce(regime <> lag(regime) OVER {_SYM} OR day - lag(day) OVER {_SYM} > 1, true) AS starts FROM g), t AS (SELECT symbol, day, regime FROM st WHERE starts AND regime <> 'NONE')"""


def regimes(spark, folder):
    p = panel(spark, folder)
    q = exact_quantiles(p.where("day < 10500"), ["symbol"], "fund", {"hi": 0.8, "lo": 0.2})
    d = p.join(q, "symbol").select("symbol", "day", F.when(F.col("fund") >= F.col("hi"), "RICH").when(F.col("fund") <= F.col("lo"), "CHEAP").otherwise("NONE").alias("regime"))
    s = sequence(d, ["symbol"], ["day"], back=1, bound=DAYS)
    prev, gap = F.lag("regime").over(s.by()), F.col("day") - F.lag("day").over(s.by())
    return s.add({"starts": F.coalesce((F.col("regime") != prev) | (gap > 1), F.lit(True))}).result()


@query("episode_starts", "K17", f"WITH {_REG} SELECT symbol, day, regime FROM t")
def episode_starts(spark, folder):
    return regimes(spark, folder).where("starts and regime <> 'NONE'").select("symbol", "day", "regime")


@query("regime_entries", "K18 K19 O15", _kept(_REG, 10))
def regime_entries(spark, folder):
    d = regimes(spark, folder).where("starts and regime <> 'NONE'").select("symbol", "day", "regime")
    return cooldown(d, ["symbol"], "day", 10)


@query("quadrant_state", "", _DERIV.join(["WITH ", """ SELECT symbol, day, CASE WHEN r > 0 AND doi > 0 THEN 'LONG_BUILD' WHEN r > 0 THEN 'SHORT_COVER' WHEN doi > 0 THEN 'SHORT_BUILD' ELSE 'LONG_UNWIND' END AS state, abs(r) * abs(doi) AS score FROM z WHERE r IS NOT NULL AND doi IS NOT NULL"""]), "score")
def quadrant_state(spark, folder):
    d = derivative_panel(spark, folder).where("r is not null and doi is not null")
    up, more = F.col("r") > 0, F.col("doi") > 0
    st = F.when(up & more, "LONG_BUILD").when(up, "SHORT_COVER").when(more, "SHORT_BUILD").otherwise("LONG_UNWIND")
    return d.select("symbol", "day", st.alias("state"), (F.abs("r") * F.abs("doi")).alias("score"))


_SCREEN = _OIZ + ", f AS (SELECT symbol, day, coalesce(zt >= 1.2, false) AS long_flag, coalesce(zt <= -1.2, false) AND NOT coalesce(zt >= 1.2, false) AS short_flag FROM z)"


@query("extreme_screen", "K21", f"WITH {_SCREEN} SELECT symbol, day, long_flag, short_flag FROM f")
def extreme_screen(spark, folder):
    return _screen(spark, folder).select("symbol", "day", "long_flag", "short_flag")


def _screen(spark, folder):
    hi, lo = F.coalesce(F.col("zt") >= 1.2, F.lit(False)), F.coalesce(F.col("zt") <= -1.2, F.lit(False))
    return oi_scores(spark, folder).withColumns({"long_flag": hi, "short_flag": lo & ~hi})


@query("screen_applied", "", f"""WITH {_SCREEN}, a AS (SELECT DISTINCT symbol FROM f WHERE long_flag AND day BETWEEN 11600 AND 11630) SELECT p.symbol, p.day, CASE WHEN a.symbol IS NOT NULL AND p.fund > 0 THEN 0 ELSE p.fund END AS fraction FROM panel p LEFT JOIN a ON a.symbol = p.symbol""", "fraction")
def screen_applied(spark, folder):
    """The flags of one month applied to all days; ``screen_as_of`` takes each day's own look-back."""
    active = _screen(spark, folder).where("long_flag and day between 11600 and 11630").select("symbol").distinct().withColumn("hit", F.lit(True))
    d = panel(spark, folder).join(active, "symbol", "left")
    return d.select("symbol", "day", F.when(F.col("hit") & (F.col("fund") > 0), 0.0).otherwise(F.col("fund")).alias("fraction"))


SCREEN_DAYS = 30


@query("screen_as_of", "K22 K23", f"""WITH {_SCREEN} SELECT symbol, p.day, CASE WHEN p.fund > 0 AND EXISTS (SELECT 1 FROM f WHERE f.symbol = p.symbol AND f.long_flag AND f.day >= p.day - {SCREEN_DAYS} AND f.day < p.day) THEN 0 ELSE p.fund END AS fraction FROM panel p""", "fraction")
def screen_as_of(spark, folder):
    d = _screen(spark, folder).select("symbol", "day", "fund", "long_flag")
    s = sequence(d, ["symbol"], ["day"], back=SCREEN_DAYS, bound=DAYS)
    before = F.max(F.when(F.col("long_flag"), F.col("day"))).over(s.rows(-SCREEN_DAYS, -1))  # one row a day: no earlier row lies in the look-back
    s = s.add({"hit": F.coalesce(before >= F.col("day") - SCREEN_DAYS, F.lit(False))})
    return s.result("symbol", "day", F.when(F.col("hit") & (F.col("fund") > 0), 0.0).otherwise(F.col("fund")).alias("fraction"))


@query("eligibility_predicates", "K24 K25", f"""WITH {_OIZ}, w AS (SELECT *, min(CASE WHEN fund > 0 THEN day END) OVER (PARTITION BY symbol) AS first_paid FROM z) SELECT symbol, day, zd IS NOT NULL AND zt IS NOT NULL AND r IS NOT NULL AND day - first_paid >= 90 AS eligible FROM w""")
def eligibility_predicates(spark, folder):
    d = oi_scores(spark, folder)
    first = d.groupBy("symbol").agg(F.min(F.when(F.col("fund") > 0, F.col("day"))).alias("first_paid"))
    ok = F.col("zd").isNotNull() & F.col("zt").isNotNull() & F.col("r").isNotNull() & (F.col("day") - F.col("first_paid") >= 90)
    return d.join(first, "symbol", "left").select("symbol", "day", ok.alias("eligible"))


@query("candidate_mask", "K26", f"WITH {_RET} SELECT symbol, bar, (bar // {HOUR_US}) % 6 = 0 OR (abs(r) >= 1 AND coalesce(abs(lag(r) OVER {_ORD}) < 1, false)) AS candidate FROM x WHERE r IS NOT NULL")
def candidate_mask(spark, folder):
    s = ret_bars(spark, folder, 2)
    cross = (F.abs("r") >= 1) & F.coalesce(F.abs(F.lag("r").over(s.by())) < 1, F.lit(False))
    d = s.add({"candidate": (F.floor(F.col("bar") / HOUR_US) % 6 == 0) | cross}).result("symbol", "bar", "r", "candidate")
    return d.where("r is not null").select("symbol", "bar", "candidate")


@query("funding_harvest", "K27", f"""WITH {_MKT}, y AS (SELECT *, CASE WHEN count(fund) OVER w >= 20 THEN (fund - avg(fund) OVER w) / nullif(stddev_samp(fund) OVER w, 0) END AS z, lag(oi) OVER {_SYM} AS oi1, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) OVER {_PW(13)} AS up FROM x WINDOW w AS {_PW(71)})
SELECT symbol, day, coalesce((fund >= 0.03 OR z >= 1.5) AND up >= 0.5 AND oi > oi1, false) AS hit FROM y""")
def funding_harvest(spark, folder):
    s = market_panel(spark, folder, 74)
    s = s.add({"z": R.z_plain(s, "fund", 72, 20), "oi1": R.lag(s, "oi"), "up": F.avg(ind(F.col("r") > 0)).over(s.rows(-13, 0))})
    hit = ((F.col("fund") >= 0.03) | (F.col("z") >= 1.5)) & (F.col("up") >= 0.5) & (F.col("oi") > F.col("oi1"))
    return s.result("symbol", "day", F.coalesce(hit, F.lit(False)).alias("hit"))


@query("carry_regime", "K28", f"""WITH {PANEL}, y AS (SELECT symbol, day, fund, round(sum(fund) OVER w, 8) AS s, count(fund) OVER w AS n, avg(fund) OVER w AS mu, stddev_samp(fund) OVER w AS sd, avg(CASE WHEN fund > 0 THEN 1.0 ELSE 0 END) OVER w AS pos, coalesce(sum(fl) OVER w, 0) AS flips FROM (SELECT *, CASE WHEN sign(fund) <> lag(sign(fund)) OVER {_SYM} THEN 1 ELSE 0 END AS fl FROM panel) WINDOW w AS {_PW(20)})
SELECT symbol, day, CASE WHEN n < 10 THEN 'NEUTRAL' WHEN s < 0 THEN 'NEGATIVE' WHEN abs(fund - mu) > 2 * sd THEN 'FLIP_RISK' WHEN mu >= 0.002 AND pos >= 0.4 AND flips <= 12 THEN 'CARRY_OK' ELSE 'UNSTABLE' END AS regime FROM y""")
def carry_regime(spark, folder):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=24, bound=DAYS)
    s = s.add({"fl": ind(F.signum("fund") != F.lag(F.signum("fund")).over(s.by()))})
    w = s.rows(-20, 0)
    mu, sd = F.avg("fund").over(w), F.stddev_samp("fund").over(w)
    reg = F.when(F.count("fund").over(w) < 10, "NEUTRAL").when(F.round(F.sum("fund").over(w), 8) < 0, "NEGATIVE").when(F.abs(F.col("fund") - mu) > 2 * sd, "FLIP_RISK")
    reg = reg.when((mu >= 0.002) & (F.avg(ind(F.col("fund") > 0)).over(w) >= 0.4) & (F.sum("fl").over(w) <= 12), "CARRY_OK").otherwise("UNSTABLE")
    return s.add({"regime": reg}).result("symbol", "day", "regime")


@query("decision_zones", "K29", f"""WITH {DECISIONS}, tau AS (SELECT symbol, quantile_cont(gross_bps, 0.9) AS a, quantile_cont(gross_bps, 0.6) AS b FROM decisions GROUP BY 1) SELECT d.id, CASE WHEN gross_bps >= a THEN 'A' WHEN gross_bps >= b THEN 'B' ELSE 'C' END AS zone FROM decisions d JOIN tau ON tau.symbol = d.symbol""")
def decision_zones(spark, folder):
    d = decisions(spark, folder)
    tau = exact_quantiles(d, ["symbol"], "gross_bps", {"a": 0.9, "b": 0.6})
    return d.join(tau, "symbol").select("id", zone(F.col("gross_bps"), F.col("a"), F.col("b")).alias("zone"))


# --- detectors with the thresholds of the protocol -------------------------------------------------

_WIN = 30
_RK = lambda x, alias: f"CASE WHEN {x} IS NOT NULL AND len(list({x}) OVER p) = {_WIN} THEN len(list_filter(list({x}) OVER p, lambda q: q <= {x})) / {_WIN}.0 END AS {alias}"
_DET = f"""{_MKT}, y AS (SELECT day, symbol, r, r - m AS resid, fund, close, oi, qv, tbq AS buys, qv - tbq AS sells, 2 * tbq - qv AS net, tbq / qv AS taker, oi / lag(oi) OVER {_SYM} - 1 AS doi, close / spot - 1 AS basis FROM x),
z AS (SELECT *, {_RK('sells', 'sell_rank')}, {_RK('qv', 'volume_rank')}, CASE WHEN count(resid) OVER p = {_WIN} THEN stddev_samp(resid) OVER p END AS sd, CASE WHEN count(basis) OVER p = {_WIN} THEN (basis - avg(basis) OVER p) / nullif(stddev_samp(basis) OVER p, 0) END AS bz,
 len(list_filter(list(fund) OVER t, lambda q: q <= fund)) / nullif(count(fund) OVER t, 0)::DOUBLE AS fund_rank FROM y WINDOW p AS {_PW(_WIN, '1 PRECEDING')}, t AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING))"""


def detector_panel(spark, folder, back=_WIN + 2):
    s = market_panel(spark, folder, back)
    return s.add({"resid": F.col("r") - F.col("m"), "buys": F.col("tbq"), "sells": F.col("qv") - F.col("tbq"), "net": 2 * F.col("tbq") - F.col("qv"), "taker": F.col("tbq") / F.col("qv"), "doi": R.pct_change(s, "oi"), "basis": F.col("close") / F.col("spot") - 1})


@query("deleveraging_events", "K2", _kept(_DET + ", t AS (SELECT symbol, day, resid, doi, sell_rank, volume_rank FROM z WHERE resid <= -1.5 * sd AND doi <= -0.03 AND sell_rank >= 0.9 AND volume_rank >= 0.8)", 48), "resid doi sell_rank volume_rank")
def deleveraging_events(spark, folder):
    s = X.deleveraging(detector_panel(spark, folder), residual="resid", oi_change="doi", sells="sells", volume="qv", window=_WIN)
    return cooldown(s.result().where("deleveraging").select("symbol", "day", "resid", "doi", "sell_rank", "volume_rank"), ["symbol"], "day", 48)


@query("crowding_events", "K3 E8", _kept(_DET + ", t AS (SELECT symbol, day, fund, fund_rank, bz, CASE WHEN fund > 0 THEN 'long' ELSE 'short' END AS crowded_side FROM z WHERE fund_rank >= 0.9 AND abs(bz) >= 2 AND doi >= 0.03 AND sign(buys - sells) = sign(fund))", 12), "fund fund_rank bz")
def crowding_events(spark, folder):
    s = detector_panel(spark, folder, 95)
    s = s.add({"bz": R.prior_z(s, "basis", _WIN), "fund_rank": X.span_rank(s, "fund", 90)})
    s = X.crowding(s, funding="fund", funding_rank="fund_rank", basis_z="bz", oi_change="doi", buys="buys", sells="sells")
    return cooldown(s.result().where("crowding").select("symbol", "day", "fund", "fund_rank", "bz", "crowded_side"), ["symbol"], "day", 12)


@query("dislocation_events", "K4 G9", _kept(_DET + """, w AS (SELECT *, round(bz, 8) - median(round(bz, 8)) OVER d AS rb, (net - avg(net) OVER d) / nullif(stddev_samp(net) OVER d, 0) AS rf, max(CASE WHEN resid IS NOT NULL OR bz IS NOT NULL OR net IS NOT NULL THEN day + CAST(floor(qv) AS BIGINT) % 3 END) OVER d AS known_at FROM z WINDOW d AS (PARTITION BY day)),
 t AS (SELECT symbol, day, known_at, sign(resid) AS trigger_sign, rb, rf FROM w WHERE abs(resid) >= 1.0 * sd AND abs(rb) >= 1 AND abs(rf) >= 1 AND sign(rb) = sign(rf) AND sign(rf) = sign(resid))""", 12), "trigger_sign rb rf", digits=4)
def dislocation_events(spark, folder):
    """Twenty names hardly ever pass three limits of 2 at once; the limits are 1 here, the operator's defaults 2."""
    s = detector_panel(spark, folder)
    d = s.add({"bz": F.round(R.prior_z(s, "basis", _WIN), 8), "known": F.col("day") + F.floor("qv") % 3}).result()
    d = X.dislocation(d, at="day", name="symbol", residual="resid", basis_z="bz", flow="net", available="known", window=_WIN, shock=1.0, z=1.0, bound=DAYS).where("dislocated")
    return cooldown(d.select("symbol", "day", "known_at", "trigger_sign", F.col("relative_basis").alias("rb"), F.col("relative_flow").alias("rf")), ["symbol"], "day", 12)


@query("ignition_events", "K8", _kept(_DET + f""", g AS (SELECT *, oi / lag(oi, 6) OVER {_SYM} - 1 AS d6, close / lag(close, 6) OVER {_SYM} - 1 AS p6 FROM z), h AS (SELECT *, CASE WHEN count(d6) OVER p >= 40 THEN (d6 - avg(d6) OVER p) / nullif(stddev_samp(d6) OVER p, 0) END AS oz, CASE WHEN count(taker) OVER p >= 40 THEN (taker - avg(taker) OVER p) / nullif(stddev_samp(taker) OVER p, 0) END AS tz FROM g WINDOW p AS {_PW(90, '1 PRECEDING')}),
 t AS (SELECT symbol, day, d6 AS oi_change, p6 AS thrust, oz AS oi_z, tz AS taker_z FROM h WHERE oz >= 3 AND d6 > 0 AND tz >= 1 AND p6 >= 0.003)""", 12), "oi_change thrust oi_z taker_z")
def ignition_events(spark, folder):
    s = X.ignition(detector_panel(spark, folder, 100), oi="oi", taker="taker", price="close", window=90, warm=40)
    return cooldown(s.result().where("ignition").select("symbol", "day", "oi_change", "thrust", "oi_z", "taker_z"), ["symbol"], "day", 12)


@query("flush_events", "K11", _kept(_DET + f""", g AS (SELECT *, oi / lag(oi, 4) OVER {_SYM} - 1 AS d4, close / lag(close, 4) OVER {_SYM} - 1 AS p4, lag(fund, 4) OVER {_SYM} AS f4 FROM y), t AS (SELECT symbol, day, d4 AS oi_change, p4 AS price_change FROM g WHERE d4 <= -0.03 AND p4 <= -0.02 AND f4 >= 0.01)""", 8), "oi_change price_change")
def flush_events(spark, folder):
    s = X.flush(detector_panel(spark, folder), oi="oi", price="close", funding="fund", least_funding=0.01)
    return cooldown(s.result().where("flush").select("symbol", "day", "oi_change", "price_change"), ["symbol"], "day", 8)


_CASC = _OIZ + """, t AS (SELECT symbol, day, CASE WHEN p3 < 0 THEN 'LONG_CASCADE' ELSE 'SHORT_SQUEEZE' END AS kind FROM z WHERE zd <= -0.5 AND abs(p3) >= 0.2)"""
FAR, DENSE = 0.6, 5


@query("cascade_variants", "K12 K13 K14", f"""WITH ev AS ({_kept(_CASC, 4)}), {PANEL}, lo AS (SELECT symbol, day, close / min(low) OVER (PARTITION BY symbol ORDER BY day ROWS 23 PRECEDING) - 1 AS dist_low FROM panel),
n AS (SELECT a.symbol, a.day, any_value(a.kind) AS kind, count(*) FILTER (b.symbol = a.symbol AND b.day >= a.day - 24) AS n_prior, count(DISTINCT b.symbol) FILTER (b.symbol <> a.symbol AND b.day > a.day - 8) AS density FROM ev a LEFT JOIN ev b ON b.day < a.day AND b.day >= a.day - 24 GROUP BY 1, 2)
SELECT n.symbol, n.day, n.n_prior, CASE WHEN n_prior = 0 THEN 'onset' WHEN n_prior >= 2 THEN 'exhaustion' ELSE 'mid' END AS bucket, density, dist_low, n_prior >= 2 AS repeat, dist_low >= {FAR} AS far_from_low, density >= {DENSE} AS systemic FROM n JOIN lo ON lo.symbol = n.symbol AND lo.day = n.day WHERE kind = 'LONG_CASCADE'""", "dist_low")
def cascade_variants(spark, folder):
    """Long cascades with what each variant of the engine asks for: earlier ones, distance from the low, other names."""
    d = oi_scores(spark, folder).where("zd <= -0.5 and abs(p3) >= 0.2").select("symbol", "day", F.when(F.col("p3") < 0, "LONG_CASCADE").otherwise("SHORT_SQUEEZE").alias("kind"))
    e = cooldown(d, ["symbol"], "day", 4)
    e = trailing_counts(e, ["symbol"], "day", 24, "n_prior")
    e = other_names_within(e, "symbol", "day", 8, "density", width=1000)
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=24, bound=DAYS)
    low = s.add({"dist_low": F.col("close") / F.min("low").over(s.rows(-23, 0)) - 1}).result("symbol", "day", "dist_low")
    d = e.where("kind = 'LONG_CASCADE'").join(low, ["symbol", "day"])
    n = F.col("n_prior").cast("bigint")
    return d.select("symbol", "day", n.alias("n_prior"), X.repeat_bucket(n).alias("bucket"), F.col("density").cast("bigint").alias("density"), "dist_low", (n >= 2).alias("repeat"), (F.col("dist_low") >= FAR).alias("far_from_low"), (F.col("density") >= DENSE).alias("systemic"))


@query("leader_shocks", "K15 K16", f"""WITH ev AS ({_kept(_CASC, 4)}), {_MKT.replace('x0 AS', 'xx0 AS').replace('FROM x0)', 'FROM xx0)')}, l AS (SELECT day, max(CASE WHEN symbol = 'P00' THEN r END) AS lr FROM x GROUP BY 1), e AS (SELECT ev.symbol, ev.day, lr FROM ev JOIN l ON l.day = ev.day WHERE ev.symbol <> 'P00' AND lr IS NOT NULL),
q AS (SELECT a.symbol, a.day, any_value(a.lr) AS lr, CASE WHEN count(b.lr) >= 200 THEN quantile_cont(abs(b.lr), 0.9) END AS level FROM e a LEFT JOIN e b ON b.day >= a.day - 365 AND (b.day, b.symbol) < (a.day, a.symbol) GROUP BY 1, 2)
SELECT symbol, day, lr, level, abs(lr) >= level AS shock, CASE WHEN lr < 0 THEN 'DOWN' ELSE 'UP' END AS shock_sign FROM q""", "lr level")
def leader_shocks(spark, folder):
    d = oi_scores(spark, folder).where("zd <= -0.5 and abs(p3) >= 0.2").select("symbol", "day")
    e = cooldown(d, ["symbol"], "day", 4)
    lead = market_panel(spark, folder, 0).result("symbol", "day", "r").where("symbol = 'P00' and r is not null").select("day", F.col("r").alias("lr"))
    e = e.where("symbol <> 'P00'").join(lead, "day").select("symbol", "day", "lr")
    e = X.shock_levels(e, clock="day", order=["symbol"], x="lr", span=365)
    return e.select("symbol", "day", "lr", "level", (F.abs("lr") >= F.col("level")).alias("shock"), F.when(F.col("lr") < 0, "DOWN").otherwise("UP").alias("shock_sign"))


_PC = lambda x: f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER p > 0 THEN len(list_filter(list({x}) OVER p, lambda q: q <= {x})) / (count({x}) OVER p)::DOUBLE END"


@query("covering_states", "K20", f"""WITH {_DET}, k AS (SELECT symbol, day, {_PC('r')} AS price_rank, {_PC('doi')} AS oi_rank FROM y WINDOW p AS {_PW(60, '1 PRECEDING')})
SELECT symbol, day, price_rank, oi_rank, CASE WHEN price_rank >= 0.9 AND oi_rank <= 0.1 THEN 'SHORT_COVERING' ELSE 'OTHER' END AS state, CASE WHEN price_rank IS NULL OR oi_rank IS NULL THEN 0.0 ELSE least(greatest(least(price_rank, 1 - oi_rank), 0), 1) END AS score FROM k""", "price_rank oi_rank score")
def covering_states(spark, folder):
    s = detector_panel(spark, folder, 62)
    s = s.add({"price_rank": R.prior_rank_share(s, "r", 60, 1), "oi_rank": R.prior_rank_share(s, "doi", 60, 1)})
    state, score = X.covering_state(F.col("price_rank"), F.col("oi_rank"))
    return s.result("symbol", "day", "price_rank", "oi_rank", state.alias("state"), score.alias("score"))
