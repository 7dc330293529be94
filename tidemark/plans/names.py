"""Cross-sections, panel signals and portfolio returns over the daily panel."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, div, flag, ind, safe_div
from tidemark.operators import portfolio as P
from tidemark.operators import recurrence as K
from tidemark.operators import resample as D
from tidemark.operators import rolling as R
from tidemark.operators.asof import asof_join
from tidemark.operators.blocks import DAYS, sequence
from tidemark.operators.crosssection import (all_present_least, average_rank, centred_rank, distinct_ranks, first_rank, neutralise,
                                             neutralise_one, orthogonal, over, spearman)
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import DAY_US, PANEL, TICKS, panel, read, ticks
from tidemark.plans.windows import _MKT, _PW, market_panel

_SYM = "(PARTITION BY symbol ORDER BY day)"
_XR = lambda x: f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY day, {x} IS NOT NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY day, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY day) - 0.5 END)"
_Z60 = lambda x: f"(CASE WHEN count({x}) OVER {_PW(59)} = 60 THEN ({x} - avg({x}) OVER {_PW(59)}) / (stddev_samp({x}) OVER {_PW(59)} + 1e-12) END)"
_ROLL = lambda f, x, n: f"(CASE WHEN count({x}) OVER {_PW(n - 1)} = {n} THEN {f}({x}) OVER {_PW(n - 1)} END)"


@query("centred_rank", "G1 G2", f"WITH {_MKT} SELECT day, symbol, {_XR('r')} AS xr FROM x", "xr")
def centred_rank_query(spark, folder):
    return market_panel(spark, folder, 0).result("day", "symbol", "r").select("day", "symbol", centred_rank("r", "day").alias("xr"))


@query("cross_sectional_features", "G3", f"""WITH {_MKT}, y AS (SELECT day, symbol, fund, oi, close / lag(close, 10) OVER {_SYM} - 1 AS mom, {_ROLL('stddev_samp', 'r', 20)} AS vol FROM x),
z AS (SELECT day, symbol, {_XR('mom')} AS r_mom, {_XR('vol')} AS r_vol, {_XR('fund')} AS r_fund, {_XR('oi')} AS r_oi FROM y)
SELECT *, (r_mom - r_vol - r_fund + r_oi) / 4 AS composite FROM z""", "r_mom r_vol r_fund r_oi composite")
def cross_sectional_features(spark, folder):
    s = market_panel(spark, folder, 22)
    d = s.add({"mom": R.pct_change(s, "close", 10), "vol": R.std(s, "r", 20)}).result("day", "symbol", "mom", "vol", "fund", "oi")
    d = d.select("day", "symbol", *[centred_rank(x, "day").alias(f"r_{x}") for x in ("mom", "vol", "fund", "oi")])
    return d.withColumn("composite", (F.col("r_mom") - F.col("r_vol") - F.col("r_fund") + F.col("r_oi")) / 4)


@query("neutralised_signal", "G4", f"""WITH {_MKT}, y AS (SELECT day, symbol, r, ln(qv) AS f FROM x WHERE r IS NOT NULL), c AS (SELECT day, count(*) AS n, regr_slope(r, f) AS b, avg(r) AS mr, avg(f) AS mf FROM y GROUP BY day)
SELECT y.day, y.symbol, y.r - mr - b * (f - mf) AS resid FROM y JOIN c ON c.day = y.day WHERE n >= 12""", "resid")
def neutralised_signal(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r", "qv").withColumn("f", F.ln("qv"))
    d = neutralise(d, at="day", y="r", factors=["f"], out="resid")
    return d.where(F.col("resid").isNotNull()).select("day", "symbol", "resid")


@query("neutralised_one_factor", "G4 G5", f"""WITH {_MKT}, y AS (SELECT day, symbol, r, ln(qv) AS f FROM x WHERE r IS NOT NULL)
SELECT day, symbol, r - avg(r) OVER w - regr_slope(r, f) OVER w * (f - avg(f) OVER w) AS resid FROM y WINDOW w AS (PARTITION BY day) QUALIFY count(*) OVER w >= 3""", "resid")
def neutralised_one_factor(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r", "qv").where("r is not null").withColumn("f", F.ln("qv"))
    d = d.withColumns({"resid": neutralise_one("r", "f", "day"), "n": over(["day"], F.count(F.lit(1)))})
    return d.where("n >= 3").select("day", "symbol", "resid")


@query("momentum_orthogonal", "G6 G8", f"""WITH {_MKT}, y AS (SELECT day, symbol, {_XR('fund')} AS s, {_XR('r')} AS m, {_XR('oi')} AS q FROM x)
SELECT day, symbol, s - sum(s * m) OVER w / nullif(sum(CASE WHEN s IS NOT NULL THEN m * m END) OVER w, 0) * m AS ortho, CASE WHEN s IS NOT NULL AND m IS NOT NULL AND q IS NOT NULL THEN least(s, m, q) END AS weakest FROM y WINDOW w AS (PARTITION BY day)""", "ortho weakest")
def momentum_orthogonal(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r", "fund", "oi")
    d = d.select("day", "symbol", centred_rank("fund", "day").alias("s"), centred_rank("r", "day").alias("m"), centred_rank("oi", "day").alias("q"))
    return d.select("day", "symbol", orthogonal("s", "m", "day").alias("ortho"), all_present_least(F.col("s"), F.col("m"), F.col("q")).alias("weakest"))


@query("universe_deviation", "G7", f"""WITH {PANEL} SELECT day, symbol, -(ratio - median(ratio) OVER w) / nullif(stddev_samp(ratio) OVER w, 0) AS dev FROM panel WINDOW w AS (PARTITION BY day)""", "dev")
def universe_deviation(spark, folder):
    w = Window.partitionBy("day")
    mid = F.percentile("ratio", F.lit(0.5)).over(w)
    return panel(spark, folder).select("day", "symbol", (-div(F.col("ratio") - mid, F.stddev_samp("ratio").over(w))).alias("dev"))


@query("relative_value_dislocation", "", f"""WITH {_MKT}, y AS (SELECT day, symbol, r - m AS resid, close / spot - 1 AS basis, 2 * tbq / qv - 1 AS flow FROM x), z AS (SELECT *, (basis - median(basis) OVER d) AS bz, (flow - avg(flow) OVER d) / nullif(stddev_samp(flow) OVER d, 0) AS fz,
 CASE WHEN count(resid) OVER p = 30 THEN stddev_samp(resid) OVER p END AS sd FROM y WINDOW d AS (PARTITION BY day), p AS {_PW(30, '1 PRECEDING')})
SELECT day, symbol, bz, fz, sd, bz > 0.1 AND fz > 0.5 AND resid > 0.5 * sd AS hit FROM z WHERE sd IS NOT NULL AND bz IS NOT NULL AND fz IS NOT NULL AND resid IS NOT NULL""", "bz fz sd")
def relative_value_dislocation(spark, folder):
    s = market_panel(spark, folder, 0)
    d = s.result().withColumns({"resid": F.col("r") - F.col("m"), "basis": F.col("close") / F.col("spot") - 1, "flow": 2 * F.col("tbq") / F.col("qv") - 1})
    w = Window.partitionBy("day")
    d = d.withColumns({"bz": F.col("basis") - F.percentile("basis", F.lit(0.5)).over(w), "fz": div(F.col("flow") - F.avg("flow").over(w), F.stddev_samp("flow").over(w))})
    s = sequence(d, ["symbol"], ["day"], back=30, bound=DAYS)
    d = s.add({"sd": R.prior(s, F.stddev_samp, "resid", 30)}).result()
    d = d.where("sd is not null and bz is not null and fz is not null and resid is not null")
    return d.select("day", "symbol", "bz", "fz", "sd", ((F.col("bz") > 0.1) & (F.col("fz") > 0.5) & (F.col("resid") > 0.5 * F.col("sd"))).alias("hit"))


@query("universe_count", "G10", f"WITH {PANEL}, e AS (SELECT day, symbol, count(*) FILTER (cnt >= 2) OVER (PARTITION BY day) AS n FROM panel) SELECT day, symbol, n FROM e WHERE n >= 5")
def universe_count(spark, folder):
    d = panel(spark, folder).select("day", "symbol", F.sum((F.col("cnt") >= 2).cast("bigint")).over(Window.partitionBy("day")).alias("n"))
    return d.where("n >= 5")


@query("causal_universe", "G11", f"""WITH {PANEL}, a AS (SELECT day, symbol, CASE WHEN count(qv) OVER w = 20 THEN median(qv) OVER w END AS adv, count(close) OVER (PARTITION BY symbol ORDER BY day ROWS 89 PRECEDING) AS alive FROM panel WINDOW w AS {_PW(19)}),
l AS (SELECT *, CASE WHEN alive >= 81 THEN adv END AS a2 FROM a)
SELECT day, symbol, a2 AS adv, row_number() OVER (PARTITION BY day, a2 IS NOT NULL ORDER BY a2 DESC, symbol) AS rk, row_number() OVER (PARTITION BY day, a2 IS NOT NULL ORDER BY a2 DESC, symbol) <= 10 AND a2 >= 40000 AS eligible FROM l WHERE a2 IS NOT NULL""", "adv")
def causal_universe(spark, folder):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=90, bound=DAYS)
    d = s.add({"adv": R.quantile(s, "qv", 20, 0.5), "alive": F.count("close").over(s.rows(-89, 0))}).result("day", "symbol", "adv", "alive")
    d = d.where("alive >= 81 and adv is not null").withColumn("rk", first_rank("adv", "symbol", "day", desc=True))
    return d.select("day", "symbol", "adv", "rk", ((F.col("rk") <= 10) & (F.col("adv") >= 40_000)).alias("eligible"))


@query("eligibility_log", "G12 G13 G14 L8 L9", f"""WITH {PANEL}, f AS (SELECT symbol, min(day) AS first_day FROM panel GROUP BY 1), on0 AS (SELECT 'P' || lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0') AS symbol, 9131 + min(s_suppkey) * 10 AS onboard FROM supplier WHERE s_suppkey % 20 < 15 GROUP BY 1),
g AS (SELECT DISTINCT day FROM panel WHERE day % 30 = 0), x AS (SELECT g.day, f.symbol, coalesce(o.onboard, f.first_day) AS start, p.close, p.qv FROM g CROSS JOIN f LEFT JOIN on0 o ON o.symbol = f.symbol LEFT JOIN panel p ON p.day = g.day AND p.symbol = f.symbol)
SELECT day, symbol, day - start AS age, CASE WHEN day - start < 90 THEN 'too_young' WHEN close IS NULL THEN 'no_price' WHEN qv < 20000 THEN 'illiquid' ELSE 'eligible' END AS reason FROM x""")
def eligibility_log(spark, folder):
    p = panel(spark, folder).select("day", "symbol", "close", "qv")
    first = p.groupBy("symbol").agg(F.min("day").alias("first_day"))
    sup = read(spark, folder, "supplier").where("s_suppkey % 20 < 15")
    on = sup.groupBy(F.concat(F.lit("P"), F.lpad((F.col("s_suppkey") % 20).cast("string"), 2, "0")).alias("symbol")).agg((9131 + F.min("s_suppkey") * 10).alias("onboard"))
    dates = p.where("day % 30 = 0").select("day").distinct()
    # Every name on every rebalance date: dates are listed per name from the panel's own calendar.
    span = p.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    lo = -(-span["a"] // 30) * 30
    d = first.withColumn("day", F.explode(F.sequence(F.lit(lo), F.lit(span["b"]), F.lit(30)))).join(dates, "day", "left_semi")
    d = d.join(on, "symbol", "left").join(p, ["day", "symbol"], "left").withColumn("age", F.col("day") - F.coalesce("onboard", "first_day"))
    reason = F.when(F.col("age") < 90, "too_young").when(F.col("close").isNull(), "no_price").when(F.col("qv") < 20_000, "illiquid").otherwise("eligible")
    return d.select("day", "symbol", "age", reason.alias("reason"))


@query("top_bucket", "G15 G17 G18", f"""WITH {_MKT}, y AS (SELECT day, symbol, qv, close / lag(close, 10) OVER {_SYM} - 1 AS mom FROM x), l AS (SELECT *, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY mom DESC, symbol) AS place FROM y WHERE qv >= 15000 AND mom IS NOT NULL AND day % 7 = 4)
SELECT day, symbol, mom, place FROM l WHERE place <= ceil(n * 0.2)""", "mom")
def top_bucket(spark, folder):
    s = market_panel(spark, folder, 10)
    d = s.add({"mom": R.pct_change(s, "close", 10)}).result("day", "symbol", "qv", "mom").where("day % 7 = 4")  # Mondays
    return P.top_bucket(d, at="day", name="symbol", score="mom", liquidity="qv", floor=15_000, fraction=0.2).select("day", "symbol", "mom", "place")


@query("long_short_buckets", "G16 G26", f"""WITH {_MKT}, l AS (SELECT day, symbol, r, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY r DESC, symbol) AS u, row_number() OVER (PARTITION BY day ORDER BY r, symbol DESC) AS d FROM x WHERE qv >= 15000 AND r IS NOT NULL)
SELECT day, symbol, CASE WHEN u <= least(ceil(n * 0.3), n // 2) THEN 1 ELSE -1 END AS leg FROM l WHERE u <= least(ceil(n * 0.3), n // 2) OR d <= least(ceil(n * 0.3), n // 2)""")
def long_short_buckets(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r", "qv")
    return P.long_short(d, at="day", name="symbol", score="r", liquidity="qv", floor=15_000, fraction=0.3).select("day", "symbol", "leg")


@query("market_states", "G19", f"""WITH {_MKT}, m AS (SELECT day, 'all' AS market, median(r) AS mkt, stddev_samp(r) AS disp, avg(fund) AS f, sum(oi) AS oi FROM x GROUP BY day)
SELECT day, CASE WHEN count(mkt) OVER w = 20 THEN stddev_samp(mkt) OVER w END AS mkt_vol, CASE WHEN count(mkt) OVER w = 20 THEN avg(mkt) OVER w END AS mkt_trend, CASE WHEN count(disp) OVER v = 5 THEN avg(disp) OVER v END AS xs_disp,
 CASE WHEN count(f) OVER q = 7 THEN avg(f) OVER q END AS mkt_funding, oi / lag(oi, 7) OVER (ORDER BY day) - 1 AS oi_growth FROM m WINDOW w AS (ORDER BY day ROWS 19 PRECEDING), v AS (ORDER BY day ROWS 4 PRECEDING), q AS (ORDER BY day ROWS 6 PRECEDING)""", "mkt_vol mkt_trend xs_disp mkt_funding oi_growth")
def market_states(spark, folder):
    d = market_panel(spark, folder, 0).result().groupBy("day").agg(
        F.percentile("r", F.lit(0.5)).alias("mkt"), F.stddev_samp("r").alias("disp"), F.avg("fund").alias("f"), F.sum("oi").alias("oi"))
    s = sequence(d.withColumn("market", F.lit("all")), ["market"], ["day"], back=20, bound=DAYS)
    return s.add({"mkt_vol": R.std(s, "mkt", 20), "mkt_trend": R.mean(s, "mkt", 20), "xs_disp": R.mean(s, "disp", 5), "mkt_funding": R.mean(s, "f", 7),
                  "oi_growth": R.pct_change(s, "oi", 7)}).result("day", "mkt_vol", "mkt_trend", "xs_disp", "mkt_funding", "oi_growth")


_QUOTES = f"""{TICKS}, v AS (SELECT symbol, ts_us // {6 * HOUR_US} AS slot, venue, max_by(price, (ts_us, event_id)) AS mid, max(ts_us) AS at_us, avg(qty) AS depth, 1 + stddev_pop(price) AS spread FROM ticks GROUP BY 1, 2, 3),
q AS (SELECT *, (slot + 1) * {6 * HOUR_US} - at_us AS age FROM v), w AS (SELECT *, power(2.0, -age / 1e6 / 7200.0) / greatest(spread, 0.05) * sqrt(depth) AS wt FROM q)"""


def _quotes(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.floor(F.col("ts_us") / (6 * HOUR_US)))
    v = t.groupBy("symbol", "slot", "venue").agg(F.max_by("price", F.struct("ts_us", "event_id")).alias("mid"), F.max("ts_us").alias("at_us"),
                                                 F.avg("qty").alias("depth"), (1 + F.stddev_pop("price")).alias("spread"))
    v = v.withColumn("age", (F.col("slot") + 1) * (6 * HOUR_US) - F.col("at_us"))
    return v.withColumn("wt", F.pow(F.lit(2.0), -F.col("age") / 1e6 / 7200.0) / F.greatest("spread", F.lit(0.05)) * F.sqrt("depth"))


@query("fair_value", "G21 G22 O12", f"""WITH {_QUOTES} SELECT symbol, slot, venue, sum(wt * mid) OVER g / nullif(sum(wt) OVER g, 0) AS fair, 10000 * (mid / nullif(sum(wt * mid) OVER g / nullif(sum(wt) OVER g, 0), 0) - 1) AS dislocation_bps,
 stddev_pop(mid) OVER g AS dispersion, (sum(wt * mid) OVER g - wt * mid) / nullif(sum(wt) OVER g - wt, 0) AS fair_without, wt / nullif(sum(wt) OVER g, 0) AS basket_weight FROM w WINDOW g AS (PARTITION BY symbol, slot) QUALIFY count(*) OVER g >= 2""", "fair dislocation_bps dispersion fair_without basket_weight", digits=4)
def fair_value(spark, folder):
    d = _quotes(spark, folder)
    g = Window.partitionBy("symbol", "slot")
    sw, swm = F.sum("wt").over(g), F.sum(F.col("wt") * F.col("mid")).over(g)
    d = d.withColumns({"fair": div(swm, sw), "dispersion": F.stddev_pop("mid").over(g), "n": F.count(F.lit(1)).over(g),
                       "fair_without": div(swm - F.col("wt") * F.col("mid"), sw - F.col("wt")), "basket_weight": div("wt", sw)}).where("n >= 2")
    return d.select("symbol", "slot", "venue", "fair", (10_000 * (div("mid", "fair") - 1)).alias("dislocation_bps"), "dispersion", "fair_without", "basket_weight")


@query("cross_section_rank_ic", "G23 N1", f"""WITH {_MKT}, y AS (SELECT day, fund AS a, r AS b FROM x WHERE r IS NOT NULL), k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY a) + (count(*) OVER (PARTITION BY day, a) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY day ORDER BY b) + (count(*) OVER (PARTITION BY day, b) - 1) / 2.0 AS rb FROM y)
SELECT day, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS ic FROM k GROUP BY day""", "ic")
def cross_section_rank_ic(spark, folder):
    return spearman(market_panel(spark, folder, 0).result("day", "fund", "r"), ["day"], "fund", "r", bounded=True)


@query("tie_guard", "G25", f"""WITH {PANEL}, u AS (SELECT day, 'fund' AS signal, round(fund, 10) AS v FROM panel UNION ALL SELECT day, 'qv', qv FROM panel UNION ALL SELECT day, 'cnt', cnt FROM panel),
k AS (SELECT signal, day, v, count(*) AS n FROM u WHERE day % 7 = 0 GROUP BY 1, 2, 3), s AS (SELECT signal, day, max(n) / sum(n) AS share FROM k GROUP BY 1, 2 HAVING sum(n) >= 5) SELECT signal, median(share) AS tie_share, median(share) <= 0.25 AS usable FROM s GROUP BY 1""", "tie_share")
def tie_guard(spark, folder):
    d = panel(spark, folder).where("day % 7 = 0").select("day", F.round("fund", 10).alias("fund"), "qv", "cnt").unpivot(["day"], ["fund", "qv", "cnt"], "signal", "v")
    k = d.groupBy("signal", "day", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("signal", "day").agg((F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("k"))
    g = k.where("k >= 5").groupBy("signal").agg(F.percentile("share", F.lit(0.5)).alias("tie_share"))
    return g.withColumn("usable", F.col("tie_share") <= 0.25)


@query("price_signals", "I1", f"""WITH {_MKT} SELECT day, symbol, close / lag(close, 20) OVER {_SYM} - 1 AS mom, lag(close) OVER {_SYM} / lag(close, 20) OVER {_SYM} - 1 AS mom_skip1, close / {_ROLL('min', 'close', 20)} - 1 AS dist_low,
 close / {_ROLL('max', 'close', 20)} - 1 AS dd_high, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) OVER {_PW(19)} AS up_share, (close / lag(close, 20) OVER {_SYM} - 1) / ({_ROLL('stddev_samp', 'r', 20)} * sqrt(20) + 1e-12) AS quality FROM x""", "mom mom_skip1 dist_low dd_high up_share quality")
def price_signals(spark, folder):
    s = market_panel(spark, folder, 22)
    mom = R.pct_change(s, "close", 20)
    return s.add({"mom": mom, "mom_skip1": R.lag(s, "close") / R.lag(s, "close", 20) - 1, "dist_low": F.col("close") / R.low(s, "close", 20) - 1,
                  "dd_high": F.col("close") / R.high(s, "close", 20) - 1, "up_share": F.avg(ind(F.col("r") > 0)).over(s.rows(-19, 0)),
                  "quality": mom / (R.std(s, "r", 20) * math.sqrt(20) + 1e-12)}).result("day", "symbol", "mom", "mom_skip1", "dist_low", "dd_high", "up_share", "quality")


@query("volatility_signals", "I2", f"""WITH {_MKT}, y AS (SELECT *, power(ln(high / low), 2) AS hl2, 0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2) AS gk, CASE WHEN r IS NOT NULL THEN least(r, 0) END AS neg, {_ROLL('stddev_samp', 'r', 20)} AS cc FROM x),
z AS (SELECT *, CASE WHEN abs(r) > 3 * cc THEN 1.0 WHEN r IS NULL OR cc IS NULL THEN 0 ELSE 0 END AS jump FROM y)
SELECT day, symbol, cc / (sqrt({_ROLL('avg', 'hl2', 20)} / (4 * ln(2))) + 1e-12) AS noise, sqrt(greatest({_ROLL('avg', 'gk', 20)}, 0)) / (cc + 1e-12) AS gk_over_cc, avg(jump) OVER {_PW(19)} AS jump_share, -{_ROLL('stddev_samp', 'neg', 20)} AS downside,
 cc / ({_ROLL('stddev_samp', 'r', 60)} + 1e-12) AS vol_trend FROM z""", "noise gk_over_cc jump_share downside vol_trend", digits=5)
def volatility_signals(spark, folder):
    s = market_panel(spark, folder, 62)
    hl2, co2 = F.pow(F.ln(F.col("high") / F.col("low")), 2), F.pow(F.ln(F.col("close") / F.col("open")), 2)
    s = s.add({"hl2": hl2, "gk": 0.5 * hl2 - (2 * math.log(2) - 1) * co2, "neg": F.when(F.col("r").isNotNull(), F.least("r", F.lit(0.0))), "cc": R.std(s, "r", 20)})
    s = s.add({"jump": flag(F.abs("r") > 3 * F.col("cc"))})
    eps = 1e-12
    return s.add({"noise": F.col("cc") / (F.sqrt(R.mean(s, "hl2", 20) / (4 * math.log(2))) + eps), "gk_over_cc": F.sqrt(clip(R.mean(s, "gk", 20), 0.0)) / (F.col("cc") + eps),
                  "jump_share": F.avg("jump").over(s.rows(-19, 0)), "downside": -R.std(s, "neg", 20), "vol_trend": F.col("cc") / (R.std(s, "r", 60) + eps)}
                 ).result("day", "symbol", "noise", "gk_over_cc", "jump_share", "downside", "vol_trend")


@query("microstructure_signals", "I3", f"""WITH {_MKT}, y AS (SELECT *, lag(r) OVER {_SYM} AS r1, abs(ln(open / lag(close) OVER {_SYM})) AS night, abs(ln(close / open)) AS intra, (close - low) / (high - low + 1e-12) AS loc FROM x), z AS (SELECT *, lag(loc) OVER {_SYM} AS loc1 FROM y)
SELECT day, symbol, CASE WHEN count(CASE WHEN r IS NOT NULL AND r1 IS NOT NULL THEN 1 END) OVER {_PW(19)} = 20 THEN 2 * sqrt(greatest(-covar_samp(r, r1) OVER {_PW(19)}, 0)) END AS roll_spread, {_ROLL('avg', 'night', 20)} / ({_ROLL('avg', 'intra', 20)} + 1e-12) AS overnight,
 {_ROLL('avg', 'loc', 20)} AS close_loc, {_ROLL('avg', 'loc1', 20)} AS close_loc_lag1 FROM z""", "roll_spread overnight close_loc close_loc_lag1", digits=5)
def microstructure_signals(spark, folder):
    s = market_panel(spark, folder, 24)
    s = s.add({"r1": R.lag(s, "r"), "night": F.abs(F.ln(F.col("open") / R.lag(s, "close"))), "intra": F.abs(F.ln(F.col("close") / F.col("open"))),
               "loc": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12)})
    s = s.add({"loc1": R.lag(s, "loc")})
    return s.add({"roll_spread": 2 * F.sqrt(clip(-R.covariance(s, "r", "r1", 20), 0.0)), "overnight": R.mean(s, "night", 20) / (R.mean(s, "intra", 20) + 1e-12),
                  "close_loc": R.mean(s, "loc", 20), "close_loc_lag1": R.mean(s, "loc1", 20)}).result("day", "symbol", "roll_spread", "overnight", "close_loc", "close_loc_lag1")


@query("liquidity_signals", "I4", f"""WITH {_MKT}, y AS (SELECT *, 1e6 * abs(r) / (qv + 1e-12) AS il, qv / lag(qv) OVER {_SYM} - 1 AS dq FROM x)
SELECT day, symbol, {_ROLL('avg', 'il', 20)} AS amihud, {_ROLL('avg', 'qv', 20)} / ({_ROLL('avg', 'qv', 60)} + 1e-12) AS vol_shock, {_ROLL('avg', 'qv', 5)} / ({_ROLL('avg', 'qv', 60)} + 1e-12) AS turnover,
 CASE WHEN count(CASE WHEN r IS NOT NULL AND dq IS NOT NULL THEN 1 END) OVER {_PW(19)} = 20 THEN corr(r, dq) OVER {_PW(19)} END AS vp_corr FROM y""", "amihud vol_shock turnover vp_corr")
def liquidity_signals(spark, folder):
    s = market_panel(spark, folder, 62)
    s = s.add({"il": 1e6 * F.abs("r") / (F.col("qv") + 1e-12), "dq": R.pct_change(s, "qv")})
    slow = R.mean(s, "qv", 60) + 1e-12
    return s.add({"amihud": R.mean(s, "il", 20), "vol_shock": R.mean(s, "qv", 20) / slow, "turnover": R.mean(s, "qv", 5) / slow,
                  "vp_corr": R.correlation(s, "r", "dq", 20)}).result("day", "symbol", "amihud", "vol_shock", "turnover", "vp_corr")


@query("taker_flow_signals", "I5 I14", f"""WITH {_MKT}, y AS (SELECT *, least(greatest(2 * tbq / (qv + 1e-12) - 1, -1), 1) AS imb, qv / (cnt + 1e-12) AS ats, close / lag(close, 10) OVER {_SYM} - 1 AS m10 FROM x),
z AS (SELECT *, {_ROLL('avg', 'imb', 10)} AS imb10, {_Z60('imb')} AS imb_z, {_Z60('ats')} AS ats_z, {_ROLL('avg', 'ats', 20)} / ({_ROLL('avg', 'ats', 60)} + 1e-12) AS ats_trend FROM y)
SELECT day, symbol, imb, imb10, imb_z, ats_z, ats_trend, {_XR('imb10')} - {_XR('m10')} AS divergence FROM z""", "imb imb10 imb_z ats_z ats_trend divergence", digits=5)
def taker_flow_signals(spark, folder):
    s = market_panel(spark, folder, 62)
    s = s.add({"imb": clip(2 * F.col("tbq") / (F.col("qv") + 1e-12) - 1, -1.0, 1.0), "ats": F.col("qv") / (F.col("cnt") + 1e-12), "m10": R.pct_change(s, "close", 10)})
    d = s.add({"imb10": R.mean(s, "imb", 10), "imb_z": R.z_full(s, "imb", 60), "ats_z": R.z_full(s, "ats", 60),
               "ats_trend": R.mean(s, "ats", 20) / (R.mean(s, "ats", 60) + 1e-12)}).result()
    return d.select("day", "symbol", "imb", "imb10", "imb_z", "ats_z", "ats_trend", (centred_rank("imb10", "day") - centred_rank("m10", "day")).alias("divergence"))


@query("funding_signals", "I6 I12 I16", f"""WITH {_MKT} SELECT day, symbol, -fund AS level, -{_Z60('fund')} AS z60, -{_ROLL('sum', 'fund', 7)} AS cum7, -({_ROLL('avg', 'fund', 7)} - {_ROLL('avg', 'fund', 21)}) AS trend7, -(fund - avg(fund) OVER (PARTITION BY day)) AS disp,
 -sign(round(fund, 9)) * CASE WHEN sign(round(fund, 9)) <> lag(sign(round(fund, 9)), 3) OVER {_SYM} OR lag(fund, 3) OVER {_SYM} IS NULL THEN 1.0 ELSE 0 END AS flip, {_ROLL('stddev_samp', 'fund', 20)} AS fvol, avg(CASE WHEN round(fund, 9) > 0 THEN 1.0 ELSE 0 END) OVER {_PW(19)} AS persistence, fund * 3 * 365 * 100 AS annual FROM x""",
       "level z60 cum7 trend7 disp flip fvol persistence annual", digits=5)
def funding_signals(spark, folder):
    s = market_panel(spark, folder, 62)
    sg = F.signum(F.round("fund", 9))
    s = s.add({"sg": sg, "sg3": F.lag(sg, 3).over(s.by())})
    flip = -F.col("sg") * ind((F.col("sg") != F.col("sg3")) | F.col("sg3").isNull())
    d = s.add({"level": -F.col("fund"), "z60": -R.z_full(s, "fund", 60), "cum7": -R.total(s, "fund", 7), "trend7": -(R.mean(s, "fund", 7) - R.mean(s, "fund", 21)),
               "flip": flip, "fvol": R.std(s, "fund", 20), "persistence": F.avg(ind(F.col("sg") > 0)).over(s.rows(-19, 0)), "annual": F.col("fund") * 3 * 365 * 100}).result()
    return d.select("day", "symbol", "level", "z60", "cum7", "trend7", (-(F.col("fund") - over(["day"], F.avg("fund")))).alias("disp"), "flip", "fvol", "persistence", "annual")


@query("open_interest_signals", "I7 I11 I17", f"""WITH {_MKT}, y AS (SELECT *, oi / lag(oi) OVER {_SYM} - 1 AS doi, oi / lag(oi, 7) OVER {_SYM} - 1 AS g7 FROM x), z AS (SELECT *, sign(doi) * sign(r) AS agree, CASE WHEN doi > 0 AND r > 0 THEN 1.0 ELSE 0 END AS q1, CASE WHEN doi < -0.3 AND r < -0.1 THEN 1.0 ELSE 0 END AS cap FROM y)
SELECT day, symbol, -g7 AS growth, -{_XR('g7')} AS growth_x, -{_Z60('oi')} AS z60, -{_ROLL('avg', 'agree', 5)} AS newlong, -(oi / ({_ROLL('avg', 'qv', 5)} + 1e-12)) AS vs_volume, sum(cap) OVER {_PW(4)} AS capitulation, avg(q1) OVER {_PW(19)} AS quadrant FROM z""",
       "growth growth_x z60 newlong vs_volume capitulation quadrant", digits=5)
def open_interest_signals(spark, folder):
    s = market_panel(spark, folder, 62)
    s = s.add({"doi": R.pct_change(s, "oi"), "g7": R.pct_change(s, "oi", 7)})
    s = s.add({"agree": F.signum("doi") * F.signum("r"), "q1": flag((F.col("doi") > 0) & (F.col("r") > 0)), "cap": flag((F.col("doi") < -0.3) & (F.col("r") < -0.1))})
    d = s.add({"growth": -F.col("g7"), "z60": -R.z_full(s, "oi", 60), "newlong": -R.mean(s, "agree", 5), "vs_volume": -(F.col("oi") / (R.mean(s, "qv", 5) + 1e-12)),
               "capitulation": F.sum("cap").over(s.rows(-4, 0)), "quadrant": F.avg("q1").over(s.rows(-19, 0))}).result()
    return d.select("day", "symbol", "growth", (-centred_rank("g7", "day")).alias("growth_x"), "z60", "newlong", "vs_volume", "capitulation", "quadrant")


@query("ratio_signals", "I8 I10", f"""WITH {PANEL}, y AS (SELECT *, round(ratio / lag(ratio, 7) OVER {_SYM}, 9) AS q7, round(ratio2 / lag(ratio2, 7) OVER {_SYM}, 9) AS p7 FROM panel)
SELECT day, symbol, -{_Z60('ratio')} AS lvl, -{_XR('ratio')} AS x, -(q7 - 1) AS chg7, {_XR('ratio2')} - {_XR('ratio')} AS smart_dumb, {_XR('p7')} - {_XR('q7')} AS smart_dumb_chg7 FROM y""", "lvl x chg7 smart_dumb smart_dumb_chg7", digits=5)
def ratio_signals(spark, folder):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=62, bound=DAYS)
    d = s.add({"q7": F.round(F.col("ratio") / R.lag(s, "ratio", 7), 9), "p7": F.round(F.col("ratio2") / R.lag(s, "ratio2", 7), 9), "lvl": -R.z_full(s, "ratio", 60)}).result()
    return d.select("day", "symbol", "lvl", (-centred_rank("ratio", "day")).alias("x"), (-(F.col("q7") - 1)).alias("chg7"),
                    (centred_rank("ratio2", "day") - centred_rank("ratio", "day")).alias("smart_dumb"), (centred_rank("p7", "day") - centred_rank("q7", "day")).alias("smart_dumb_chg7"))


@query("interaction_signals", "I9", f"""WITH {_MKT}, y AS (SELECT *, oi / lag(oi, 7) OVER {_SYM} - 1 AS g7, {_Z60('fund')} AS zf, {_Z60('oi')} AS zo FROM x)
SELECT day, symbol, -({_XR('fund')} * {_XR('g7')}) AS crowding, CASE WHEN zf IS NOT NULL AND zo IS NOT NULL THEN -(least(greatest(zf, -3), 3) * least(greatest(zo, -3), 3)) END AS crowding_z FROM y""", "crowding crowding_z", digits=5)
def interaction_signals(spark, folder):
    s = market_panel(spark, folder, 62)
    d = s.add({"g7": R.pct_change(s, "oi", 7), "zf": R.z_full(s, "fund", 60), "zo": R.z_full(s, "oi", 60)}).result()
    return d.select("day", "symbol", (-(centred_rank("fund", "day") * centred_rank("g7", "day"))).alias("crowding"), (-(clip("zf", -3.0, 3.0) * clip("zo", -3.0, 3.0))).alias("crowding_z"))


@query("basis_signals", "I13 I18 I19 I21", f"""WITH {_MKT}, y AS (SELECT *, round(close / spot - 1, 6) AS b, 30 + day % 90 AS dte FROM x)
SELECT day, symbol, {_XR('b')} AS rank_b, {_Z60('b')} AS z60, b - lag(b, 5) OVER {_SYM} AS chg5, b * 365 / dte * 100 AS annual, fund * 3 * 365 * 100 - b * 365 / dte * 100 AS disagreement FROM y""", "rank_b z60 chg5 annual disagreement", digits=4)
def basis_signals(spark, folder):
    s = market_panel(spark, folder, 62)
    s = s.add({"b": F.round(F.col("close") / F.col("spot") - 1, 6), "dte": 30 + F.col("day") % 90})
    annual = F.col("b") * 365 / F.col("dte") * 100
    d = s.add({"z60": R.z_full(s, "b", 60), "chg5": R.change(s, "b", 5), "annual": annual, "disagreement": F.col("fund") * 3 * 365 * 100 - annual}).result()
    return d.select("day", "symbol", centred_rank("b", "day").alias("rank_b"), "z60", "chg5", "annual", "disagreement")


@query("forecast_combine", "I22", f"""WITH {PANEL}, z AS (SELECT day, symbol, [round({_Z60('fund')}, 7), round(-{_Z60('oi')}, 7), round({_Z60('ratio')}, 7)] AS zs FROM panel), f AS (SELECT day, symbol, list_filter(zs, lambda q: q IS NOT NULL) AS h FROM z)
SELECT day, symbol, list_avg(h) AS score, CASE WHEN list_avg(h) > 0.5 THEN 'UP' WHEN list_avg(h) < -0.5 THEN 'DOWN' ELSE 'FLAT' END AS direction, len(list_filter(h, lambda q: sign(q) = sign(list_avg(h)))) / len(h)::DOUBLE AS agreement FROM f WHERE len(h) > 0""", "score agreement", digits=5)
def forecast_combine(spark, folder):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=60, bound=DAYS)
    s = s.add({"h": F.array_compact(F.array(*[F.round(z, 7) for z in (R.z_full(s, "fund", 60), -R.z_full(s, "oi", 60), R.z_full(s, "ratio", 60))]))})
    d = s.result("day", "symbol", "h").where(F.size("h") > 0)
    d = d.withColumn("score", F.aggregate("h", F.lit(0.0), lambda a, v: a + v) / F.size("h"))
    direction = F.when(F.col("score") > 0.5, "UP").when(F.col("score") < -0.5, "DOWN").otherwise("FLAT")
    agree = F.size(F.filter("h", lambda v: F.signum(v) == F.signum("score"))) / F.size("h")
    return d.select("day", "symbol", "score", direction.alias("direction"), agree.alias("agreement"))


# --- portfolios --------------------------------------------------------------------------------

_CAL = f"""{_MKT}, s0 AS (SELECT day, symbol, close, qv, r, close / lag(close, 10) OVER {_SYM} - 1 AS score, lead(close) OVER {_SYM} / close - 1 AS ret1 FROM x),
g AS (SELECT symbol, unnest(generate_series((SELECT min(day) FROM panel), (SELECT max(day) FROM panel))) AS day FROM (SELECT DISTINCT symbol FROM panel)),
c AS (SELECT g.day, g.symbol, s0.score, s0.ret1, s0.qv FROM g LEFT JOIN s0 ON s0.day = g.day AND s0.symbol = g.symbol),
rk AS (SELECT *, count(score) OVER (PARTITION BY day) AS n, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY day, score IS NOT NULL ORDER BY score, symbol) END AS k FROM c),
tg AS (SELECT *, CASE WHEN n < 8 OR k IS NULL THEN 0.0 WHEN k <= 3 THEN -1 / 3.0 WHEN k > n - 3 THEN 1 / 3.0 ELSE 0 END AS target FROM rk)"""


def calendar_scores(spark, folder):
    s = market_panel(spark, folder, 12)
    s = sequence(s.result(), ["symbol"], ["day"], back=12, ahead=1, bound=DAYS)
    d = s.add({"score": R.pct_change(s, "close", 10), "ret1": F.lead("close").over(s.by()) / F.col("close") - 1}).result("day", "symbol", "score", "ret1", "qv")
    return D.on_calendar(d, keys=["symbol"], clock="day", step=1)


@query("overlapping_portfolio", "O1 O2", f"""WITH {_CAL}, w AS (SELECT *, avg(target) OVER (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING) AS w FROM tg), e AS (SELECT *, coalesce(lag(w, 1) OVER {_SYM}, 0) AS e FROM w),
x2 AS (SELECT *, CASE WHEN ret1 IS NOT NULL THEN e ELSE 0 END AS xw FROM e), d2 AS (SELECT *, abs(xw - coalesce(lag(xw) OVER {_SYM}, 0)) AS dw FROM x2)
SELECT day, sum(xw * coalesce(ret1, 0) * 10000) AS gross_bps, sum(dw * 8 / 2) AS cost_bps, sum(dw) AS turnover FROM d2 GROUP BY day""", "gross_bps cost_bps turnover", digits=4)
def overlapping_portfolio(spark, folder):
    d = P.targets(calendar_scores(spark, folder), at="day", name="symbol", score="score", k=3)
    return P.overlapping_returns(d, at="day", name="symbol", ret="ret1", span=5, lag=1, cost=F.lit(8.0))


@query("portfolio_grid", "O3 N58", f"""WITH {_CAL}, cfg AS (SELECT unnest([1, 5, 10]) AS span), w AS (SELECT tg.day, tg.symbol, tg.ret1, cfg.span, CASE cfg.span WHEN 1 THEN target WHEN 5 THEN avg(target) OVER (PARTITION BY symbol, span ORDER BY day ROWS 4 PRECEDING) ELSE avg(target) OVER (PARTITION BY symbol, span ORDER BY day ROWS 9 PRECEDING) END AS w FROM tg CROSS JOIN cfg),
e AS (SELECT *, CASE WHEN ret1 IS NOT NULL THEN coalesce(lag(w) OVER (PARTITION BY symbol, span ORDER BY day), 0) ELSE 0 END AS xw FROM w), d2 AS (SELECT *, abs(xw - coalesce(lag(xw) OVER (PARTITION BY symbol, span ORDER BY day), 0)) AS dw FROM e),
p AS (SELECT span, day, sum(xw * coalesce(ret1, 0) * 10000) AS gross, sum(dw * 4) AS cost FROM d2 GROUP BY 1, 2)
SELECT span, avg(gross) AS gross_bps, avg(cost) AS cost_bps, avg(gross - cost) AS net_bps, avg(-gross - cost) AS net_inverse_bps FROM p GROUP BY span""", "gross_bps cost_bps net_bps net_inverse_bps", digits=4)
def portfolio_grid(spark, folder):
    d = P.targets(calendar_scores(spark, folder), at="day", name="symbol", score="score", k=3)
    s = sequence(d, ["symbol"], ["day"], back=14, bound=DAYS)
    # All configurations share one pass: a column per span, then one row per (day, span).
    spans = (1, 5, 10)
    s = s.add({f"w{n}": F.avg("target").over(s.rows(-(n - 1), 0)) for n in spans})
    s = s.add({f"x{n}": F.when(F.col("ret1").isNotNull(), F.coalesce(F.lag(f"w{n}").over(s.by()), F.lit(0.0))).otherwise(0.0) for n in spans})
    s = s.add({f"d{n}": F.abs(F.col(f"x{n}") - F.coalesce(F.lag(f"x{n}").over(s.by()), F.lit(0.0))) for n in spans})
    rows = F.array(*[F.struct(F.lit(n).alias("span"), F.col(f"x{n}").alias("x"), F.col(f"d{n}").alias("d")) for n in spans])
    d = s.result("day", "ret1", F.explode(rows).alias("c")).groupBy(F.col("c.span").alias("span"), "day").agg(
        F.sum(F.col("c.x") * F.coalesce("ret1", F.lit(0.0)) * 1e4).alias("g"), F.sum(F.col("c.d") * 4).alias("k"))
    return d.groupBy("span").agg(F.avg("g").alias("gross_bps"), F.avg("k").alias("cost_bps"), F.avg(F.col("g") - F.col("k")).alias("net_bps"), F.avg(-F.col("g") - F.col("k")).alias("net_inverse_bps"))


@query("symbol_cost_model", "O4", f"""WITH {PANEL}, a AS (SELECT day, symbol, CASE WHEN count(qv) OVER w = 20 THEN median(qv) OVER w END AS adv FROM panel WINDOW w AS {_PW(19)})
SELECT day, symbol, coalesce(8 * least(greatest(sqrt(median(adv) OVER (PARTITION BY day) / adv), 1), 4) + CASE WHEN adv IS NULL THEN NULL ELSE 0 END, 32) AS cost_bps FROM a""", "cost_bps")
def symbol_cost_model(spark, folder):
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=20, bound=DAYS)
    d = s.add({"adv": R.quantile(s, "qv", 20, 0.5)}).result("day", "symbol", "adv")
    return d.select("day", "symbol", P.liquidity_cost(8.0, F.col("adv"), over(["day"], F.percentile("adv", F.lit(0.5)))).alias("cost_bps"))


@query("capped_weights", "O5 O6")
def capped_weights(spark, folder):
    d = panel(spark, folder).select("day", "symbol", F.col("qv").alias("raw"))
    return P.capped_weights(d, group=["day"], name="symbol", raw="raw", cap=0.2, out="weight").select("day", "symbol", "raw", "weight")


@query("beta_hedged_returns", "O7 O8", f"""WITH {_MKT}, b AS (SELECT day, symbol, r, m, fund, covar_samp(r, m) OVER w / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER w, 0) AS beta, count(r) OVER w AS n FROM x WINDOW w AS {_PW(60, '1 PRECEDING')}),
l AS (SELECT *, count(*) OVER (PARTITION BY day) AS k, row_number() OVER (PARTITION BY day ORDER BY fund, symbol) AS p FROM b WHERE n >= 20 AND r IS NOT NULL),
w AS (SELECT *, CASE WHEN p <= 3 THEN 1 / 3.0 WHEN p > k - 3 THEN -1 / 3.0 ELSE 0 END AS wt FROM l WHERE k >= 8)
SELECT day, -sum(wt * beta) AS hedge, sum(wt * r) - sum(wt * beta) * avg(m) AS ret, -sum(wt * fund) AS carry FROM w GROUP BY day""", "hedge ret carry")
def beta_hedged_returns(spark, folder):
    s = market_panel(spark, folder, 60)
    w = s.rows(-60, -1)
    d = s.add({"beta": R.prior_beta(s, "r", "m", 60, 1), "n": F.count("r").over(w)}).result().where("n >= 20 and r is not null")
    d = d.withColumns({"k": over(["day"], F.count(F.lit(1))), "p": first_rank("fund", "symbol", "day")}).where("k >= 8")
    wt = F.when(F.col("p") <= 3, 1 / 3.0).when(F.col("p") > F.col("k") - 3, -1 / 3.0).otherwise(0.0)
    d = d.withColumn("wt", wt)
    hb = F.sum(F.col("wt") * F.col("beta"))
    return d.groupBy("day").agg((-hb).alias("hedge"), (F.sum(F.col("wt") * F.col("r")) - hb * F.avg("m")).alias("ret"), (-F.sum(F.col("wt") * F.col("fund"))).alias("carry"))


@query("decile_spread", "O10 O11", f"""WITH {_CAL}, d AS (SELECT day, symbol, score, ret1, n, k, qv FROM rk WHERE k IS NOT NULL AND day % 5 = 0 AND n >= 10 AND ret1 IS NOT NULL),
l AS (SELECT day, avg(ret1) FILTER (k > n - n // 10) - avg(ret1) FILTER (k <= n // 10) AS spread, min(qv) FILTER (k > n - n // 10 OR k <= n // 10) AS capacity FROM d GROUP BY day) SELECT day, spread, spread - 0.002 AS net, capacity FROM l""", "spread net capacity")
def decile_spread(spark, folder):
    d = calendar_scores(spark, folder).where("day % 5 = 0")
    d = d.withColumns({"n": over(["day"], F.count("score")), "k": first_rank("score", "symbol", "day")}).where("k is not null and n >= 10 and ret1 is not null")
    top, low = F.col("k") > F.col("n") - F.floor(F.col("n") / 10), F.col("k") <= F.floor(F.col("n") / 10)
    d = d.groupBy("day").agg((F.avg(F.when(top, F.col("ret1"))) - F.avg(F.when(low, F.col("ret1")))).alias("spread"), F.min(F.when(top | low, F.col("qv"))).alias("capacity"))
    return d.withColumn("net", F.col("spread") - 0.002)
