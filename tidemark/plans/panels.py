"""Event panels, contexts, targets and lead-lag tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import div
from tidemark.operators import labels as L
from tidemark.operators import rolling as R
from tidemark.operators.asof import Context, asof_contexts
from tidemark.operators.blocks import DAYS, HOURS, sequence
from tidemark.operators.crosssection import lead_lag, spearman
from tidemark.operators.resample import HOUR_US, calendar
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, PANEL, TICKS, bars, panel, ticks
from tidemark.plans.windows import _MKT, _ORD, _PW, _RET, _W, market_panel, ret_bars

_VEN = f"""{TICKS}, v AS (SELECT symbol, ts_us // {DAY_US} AS slot, avg(price) FILTER (venue = 0) AS v0, avg(price) FILTER (venue = 1) AS v1, avg(price) FILTER (venue = 2) AS v2 FROM ticks GROUP BY 1, 2)"""
_LAGS = ", ".join(f"lag(v{m}, {k}) OVER w AS l{k}_{m}" for m in range(3) for k in (1, 2))
_PAIRS = " UNION ALL ".join(f"SELECT symbol, {a} AS leader, {b} AS follower, {k} AS lag, corr(l{k}_{a}, v{b}) AS r FROM l GROUP BY symbol" for a in range(3) for b in range(3) if a != b for k in (1, 2))


@query("venue_lead_lag", "E40", f"WITH {_VEN}, l AS (SELECT *, {_LAGS} FROM v WINDOW w AS (PARTITION BY symbol ORDER BY slot)), p AS ({_PAIRS}) SELECT symbol, leader, follower, arg_max(lag, (abs(r), -lag)) AS lag, arg_max(r, (abs(r), -lag)) AS r FROM p GROUP BY 1, 2, 3", "r")
def venue_lead_lag(spark, folder):
    t = ticks(spark, folder).groupBy("symbol", F.floor(F.col("ts_us") / DAY_US).alias("slot"), "venue").agg(F.avg("price").alias("mid"))
    return lead_lag(t, ["symbol"], "slot", "venue", "mid", [0, 1, 2], 2)


@query("event_feature_panel", "I28", f"""WITH {TICKS}, g AS (SELECT symbol, unnest(generate_series((SELECT min(ts_us) - min(ts_us) % {6 * HOUR_US} FROM ticks), (SELECT max(ts_us) FROM ticks), {6 * HOUR_US})) AS slot FROM (SELECT DISTINCT symbol FROM ticks)),
p AS (SELECT symbol, ts_us, ts_us + 5000000 AS avail, price FROM ticks WHERE kind = 'view'), o AS (SELECT symbol, ts_us, ts_us + 65000000 AS avail, qty FROM ticks WHERE kind = 'signup'),
a AS (SELECT g.*, p.price, p.avail AS a1 FROM g ASOF LEFT JOIN p ON p.symbol = g.symbol AND g.slot >= p.avail), b AS (SELECT a.*, o.qty AS oi, o.avail AS a2 FROM a ASOF LEFT JOIN o ON o.symbol = a.symbol AND a.slot >= o.avail)
SELECT symbol, slot, price, oi, greatest(a1, a2) AS research_available FROM b""", "price")
def event_feature_panel(spark, folder):
    t = ticks(spark, folder)
    g = calendar(t.select("symbol", F.col("ts_us").alias("slot")), keys=["symbol"], clock="slot", step=6 * HOUR_US)
    p = t.where("kind = 'view'").select("symbol", "event_id", (F.col("ts_us") + 5_000_000).alias("avail"), "price")
    o = t.where("kind = 'signup'").select("symbol", "event_id", (F.col("ts_us") + 65_000_000).alias("avail"), F.col("qty").alias("oi"))
    d = asof_contexts(g, [Context(p, "avail", ["price"], "p_", ["event_id"]), Context(o, "avail", ["oi"], "o_", ["event_id"])], by=["symbol"], left_clock="slot")
    return d.select("symbol", "slot", F.col("p_price").alias("price"), F.col("o_oi").alias("oi"), F.greatest("p_avail", "o_avail").alias("research_available"))


@query("discovery_enrichment", "I29 I30", f"""WITH {_MKT}, y AS (SELECT day, symbol, ln(oi) AS lo, ln(qv / cnt) AS lt, r FROM x) SELECT day, symbol, CASE WHEN count(lo) OVER p >= 20 THEN (lo - avg(lo) OVER p) / nullif(stddev_samp(lo) OVER p, 0) END AS oi_z, CASE WHEN count(lt) OVER p >= 20 THEN (lt - avg(lt) OVER p) / nullif(stddev_samp(lt) OVER p, 0) END AS size_z,
 CASE WHEN count(r) OVER p >= 20 THEN (r - avg(r) OVER p) / nullif(stddev_samp(r) OVER p, 0) END AS ret_z FROM y WINDOW p AS {_PW(40, '1 PRECEDING')}""", "oi_z size_z ret_z")
def discovery_enrichment(spark, folder):
    s = market_panel(spark, folder, 42)
    s = s.add({"lo": F.ln("oi"), "lt": F.ln(F.col("qv") / F.col("cnt"))})
    return s.add({"oi_z": R.prior_z(s, "lo", 40, 20), "size_z": R.prior_z(s, "lt", 40, 20), "ret_z": R.prior_z(s, "r", 40, 20)}).result("day", "symbol", "oi_z", "size_z", "ret_z")


@query("market_context", "I31", f"WITH {_RET} SELECT x.symbol, x.bar, x.r, b.r AS lead_ret, b.volume AS lead_volume, x.r - b.r AS excess FROM x LEFT JOIN x b ON b.bar = x.bar AND b.symbol = 'S00'", "r lead_ret lead_volume excess")
def market_context(spark, folder):
    d = ret_bars(spark, folder, 1).result("symbol", "bar", "r", "volume")
    lead = d.where("symbol = 'S00'").select("bar", F.col("r").alias("lead_ret"), F.col("volume").alias("lead_volume"))
    return d.join(lead, "bar", "left").select("symbol", "bar", "r", "lead_ret", "lead_volume", (F.col("r") - F.col("lead_ret")).alias("excess"))


@query("named_targets", "M7", f"""WITH {_RET} SELECT symbol, bar, ln(lead(close, 3) OVER {_ORD} / close) AS forward_return, 10000 * ln(lead(close, 3) OVER {_ORD} / close) AS forward_bps, CASE WHEN count(r) OVER w = 3 THEN stddev_samp(r) OVER w END AS future_volatility, -(lead(close, 3) OVER {_ORD} - close) AS convergence
 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""", "forward_return forward_bps future_volatility convergence")
def named_targets(spark, folder):
    s = ret_bars(spark, folder, 1, 3)
    names = ("forward_return", "forward_bps", "future_volatility", "convergence")
    return s.add({k: L.target(s, k, "close", 3) for k in names}).result("symbol", "bar", *names)


@query("leave_one_out_targets", "M9", f"""WITH {_VEN}, u AS (SELECT symbol, slot, 0 AS venue, (coalesce(v1, 0) + coalesce(v2, 0)) / nullif((v1 IS NOT NULL)::INT + (v2 IS NOT NULL)::INT, 0) AS fair FROM v UNION ALL SELECT symbol, slot, 1, (coalesce(v0, 0) + coalesce(v2, 0)) / nullif((v0 IS NOT NULL)::INT + (v2 IS NOT NULL)::INT, 0) FROM v UNION ALL SELECT symbol, slot, 2, (coalesce(v0, 0) + coalesce(v1, 0)) / nullif((v0 IS NOT NULL)::INT + (v1 IS NOT NULL)::INT, 0) FROM v)
SELECT symbol, slot, venue, 10000 * ln(lead(fair) OVER w / fair) AS future_bps, 10000 * ln(fair / lag(fair) OVER w) AS past_bps FROM u WINDOW w AS (PARTITION BY symbol, venue ORDER BY slot)""", "future_bps past_bps", digits=4)
def leave_one_out_targets(spark, folder):
    t = ticks(spark, folder).groupBy("symbol", F.floor(F.col("ts_us") / DAY_US).alias("slot"), "venue").agg(F.avg("price").alias("mid"))
    tot = t.groupBy("symbol", "slot").agg(F.sum("mid").alias("s"), F.count(F.lit(1)).alias("n"))
    d = tot.withColumn("venue", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)]))).join(t, ["symbol", "slot", "venue"], "left")
    d = d.withColumn("fair", div(F.col("s") - F.coalesce("mid", F.lit(0.0)), F.col("n") - F.col("mid").isNotNull().cast("int")))
    s = sequence(d.select("symbol", "venue", "slot", "fair"), ["symbol", "venue"], ["slot"], back=1, ahead=1, bound=DAYS)
    return s.add({"future_bps": 1e4 * F.ln(div(F.lead("fair").over(s.by()), "fair")), "past_bps": 1e4 * F.ln(div("fair", F.lag("fair").over(s.by())))}).result("symbol", "slot", "venue", "future_bps", "past_bps")


@query("label_store", "M40", f"""WITH {_RET}, l AS (SELECT symbol, bar, ln(lead(close, 1) OVER {_ORD} / close) AS ret_1, ln(lead(close, 12) OVER {_ORD} / close) AS ret_12 FROM x) SELECT symbol, bar, 'ret_1' AS label, ret_1 AS value FROM l WHERE ret_1 IS NOT NULL UNION ALL SELECT symbol, bar, 'ret_12', ret_12 FROM l WHERE ret_12 IS NOT NULL
 UNION ALL SELECT symbol, bar, 'sign_12', sign(ret_12) FROM l WHERE ret_12 IS NOT NULL""", "value")
def label_store(spark, folder):
    s = ret_bars(spark, folder, 1, 12)
    s = s.add({"ret_1": L.forward_log_return(s, "close", 1), "ret_12": L.forward_log_return(s, "close", 12)})
    s = s.add({"sign_12": F.signum("ret_12")})
    d = s.result("symbol", "bar", "ret_1", "ret_12", "sign_12").unpivot(["symbol", "bar"], ["ret_1", "ret_12", "sign_12"], "label", "value")
    return d.where("value is not null")


@query("open_interest_quadrants", "I11", f"""WITH {_MKT}, y AS (SELECT *, oi / lag(oi) OVER (PARTITION BY symbol ORDER BY day) - 1 AS doi FROM x) SELECT day, symbol, avg(CASE WHEN doi > 0 AND r > 0 THEN 1.0 ELSE 0 END) OVER w AS long_build, avg(CASE WHEN doi > 0 AND r < 0 THEN 1.0 ELSE 0 END) OVER w AS short_build, avg(CASE WHEN doi < 0 AND r > 0 THEN 1.0 ELSE 0 END) OVER w AS short_cover,
 avg(CASE WHEN doi < 0 AND r < 0 THEN 1.0 ELSE 0 END) OVER w AS long_unwind FROM y WINDOW w AS {_PW(19)}""", "long_build short_build short_cover long_unwind")
def open_interest_quadrants(spark, folder):
    from tidemark.functions.scalars import ind
    s = market_panel(spark, folder, 22)
    s = s.add({"doi": R.pct_change(s, "oi")})
    w, d, r = s.rows(-19, 0), F.col("doi"), F.col("r")
    share = lambda cond: F.avg(ind(cond)).over(w)
    return s.add({"long_build": share((d > 0) & (r > 0)), "short_build": share((d > 0) & (r < 0)), "short_cover": share((d < 0) & (r > 0)), "long_unwind": share((d < 0) & (r < 0))}
                 ).result("day", "symbol", "long_build", "short_build", "short_cover", "long_unwind")


@query("cohort_disagreement", "I10", f"""WITH {PANEL}, z AS (SELECT day, symbol, CASE WHEN count(ratio) OVER w = 30 THEN (ratio - avg(ratio) OVER w) / (stddev_samp(ratio) OVER w + 1e-12) END AS za, CASE WHEN count(ratio2) OVER w = 30 THEN (ratio2 - avg(ratio2) OVER w) / (stddev_samp(ratio2) OVER w + 1e-12) END AS zb FROM panel WINDOW w AS {_PW(29)}) SELECT day, symbol, zb - za AS z_gap FROM z""", "z_gap", digits=5)
def cohort_disagreement(spark, folder):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=30, bound=DAYS)
    return s.add({"z_gap": R.z_full(s, "ratio2", 30) - R.z_full(s, "ratio", 30)}).result("day", "symbol", "z_gap")


@query("carry_signals", "I12", f"""WITH {PANEL} SELECT day, symbol, avg(fund) OVER {_PW(6)} - avg(fund) OVER {_PW(29)} AS acceleration, CASE WHEN count(fund) OVER {_PW(19)} = 20 THEN avg(fund) OVER {_PW(19)} / (stddev_samp(fund) OVER {_PW(19)} + 1e-12) END AS quality, avg(CASE WHEN fund > 0 THEN 1.0 ELSE 0 END) OVER {_PW(29)} AS positive_share FROM panel""", "acceleration quality positive_share", digits=5)
def carry_signals(spark, folder):
    from tidemark.functions.scalars import ind
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=30, bound=DAYS)
    return s.add({"acceleration": R.mean(s, "fund", 7, 1) - R.mean(s, "fund", 30, 1), "quality": R.mean(s, "fund", 20) / (R.std(s, "fund", 20) + 1e-12),
                  "positive_share": F.avg(ind(F.col("fund") > 0)).over(s.rows(-29, 0))}).result("day", "symbol", "acceleration", "quality", "positive_share")


@query("funding_features", "I16", f"""WITH {PANEL}, y AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM panel) SELECT day, symbol, CASE WHEN count(fund) OVER w >= 30 THEN (fund - avg(fund) OVER w) / nullif(stddev_samp(fund) OVER w, 0) END AS z90, CASE WHEN count(fund) OVER s >= 2 THEN coalesce(regr_slope(fund, i) OVER s, 0) END AS slope9, sum(fund) OVER s AS sum9, min(fund) OVER s > 0 AS all_positive
 FROM y WINDOW w AS {_PW(89)}, s AS {_PW(8)}""", "z90 slope9 sum9")
def funding_features(spark, folder):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=90, bound=DAYS)
    s = s.add({"i": F.row_number().over(s.by())})
    return s.add({"z90": R.z_plain(s, "fund", 90, 30), "slope9": R.slope(s, "fund", 9, "i", 2), "sum9": R.total(s, "fund", 9, 1), "all_positive": F.min("fund").over(s.rows(-8, 0)) > 0}
                 ).result("day", "symbol", "z90", "slope9", "sum9", "all_positive")


@query("cross_exchange_funding_panel", "I19", f"""WITH {PANEL}, y AS (SELECT day, symbol, close, ratio - ratio2 AS spread, (ratio + ratio2) / 2 AS consensus FROM panel) SELECT day, symbol, spread, consensus, CASE WHEN count(spread) OVER w >= 10 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS spread_z30,
 sign(round(spread, 9)) <> lag(sign(round(spread, 9))) OVER o AS flipped, lead(close, 3) OVER o / close - 1 AS fwd3 FROM y WINDOW w AS {_PW(29)}, o AS (PARTITION BY symbol ORDER BY day)""", "spread consensus spread_z30 fwd3", digits=5)
def cross_exchange_funding_panel(spark, folder):
    d = panel(spark, folder).withColumns({"spread": F.col("ratio") - F.col("ratio2"), "consensus": (F.col("ratio") + F.col("ratio2")) / 2})
    s = sequence(d, ["symbol"], ["day"], back=30, ahead=3, bound=DAYS)
    sg = F.signum(F.round("spread", 9))
    return s.add({"spread_z30": R.z_plain(s, "spread", 30, 10), "flipped": sg != F.lag(sg).over(s.by()), "fwd3": div(F.lead("close", 3).over(s.by()), "close") - 1}
                 ).result("day", "symbol", "spread", "consensus", "spread_z30", "flipped", "fwd3")


@query("regime_ics", "N14", f"""WITH {_MKT}, y AS (SELECT symbol, fund, r, lag(r) OVER (PARTITION BY symbol ORDER BY day) AS past FROM x), f AS (SELECT symbol, CASE WHEN past > 0 THEN 'up' ELSE 'down' END AS regime, fund, r FROM y WHERE r IS NOT NULL AND past IS NOT NULL),
k AS (SELECT symbol, regime, rank() OVER (PARTITION BY symbol, regime ORDER BY fund) + (count(*) OVER (PARTITION BY symbol, regime, fund) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol, regime ORDER BY r) + (count(*) OVER (PARTITION BY symbol, regime, r) - 1) / 2.0 AS b FROM f) SELECT symbol, regime, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY 1, 2""", "ic")
def regime_ics(spark, folder):
    s = market_panel(spark, folder, 2)
    d = s.add({"past": F.lag("r").over(s.by())}).result("symbol", "fund", "r", "past").where("r is not null and past is not null")
    return spearman(d.withColumn("regime", F.when(F.col("past") > 0, "up").otherwise("down")), ["symbol", "regime"], "fund", "r")


@query("sub_period_stability", "N44", f"""WITH {_MKT}, y AS (SELECT symbol, r, ntile(4) OVER (PARTITION BY symbol ORDER BY day) AS part FROM x WHERE r IS NOT NULL), p AS (SELECT symbol, part, avg(r) AS m FROM y GROUP BY 1, 2) SELECT symbol, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END) AS positive_share FROM p GROUP BY 1""", "positive_share")
def sub_period_stability(spark, folder):
    from tidemark.functions.scalars import ind
    d = market_panel(spark, folder, 0).result("symbol", "day", "r").where("r is not null")
    d = d.withColumn("part", F.ntile(4).over(Window.partitionBy("symbol").orderBy("day")))  # one row per name and day
    return d.groupBy("symbol", "part").agg(F.avg("r").alias("m")).groupBy("symbol").agg(F.avg(ind(F.col("m") > 0)).alias("positive_share"))
