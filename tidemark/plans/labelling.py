"""Forward labels, barriers and path statistics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import div, flag, ind
from tidemark.operators import labels as L
from tidemark.operators import rolling as R
from tidemark.operators.asof import Context, asof_contexts, asof_join
from tidemark.operators.blocks import HOURS, RN, number_rows, running_total, sequence
from tidemark.operators.crosssection import exact_quantiles
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, PANEL, TICKS, bars, panel, ticks
from tidemark.plans.windows import _ORD, _RET, _W, ret_bars
from tidemark.session import pin

_FW = lambda a, b: f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


@query("forward_returns", "M1 M2 M3 M8 M21 M28 H44", f"""WITH {_RET} SELECT symbol, bar, ln(lead(close, 1) OVER w / close) AS f1, ln(lead(close, 4) OVER w / close) AS f4, ln(lead(close, 12) OVER w / close) AS f12,
 10000 * ln(lead(close, 4) OVER w / close) AS bps4, 10000 * ln(close / lag(close, 4) OVER w) AS past4, lead(close, 4) OVER w / close - 1 - 0.0008 AS pnl4 FROM x WINDOW w AS {_ORD}""", "f1 f4 f12 bps4 past4 pnl4")
def forward_returns(spark, folder):
    s = ret_bars(spark, folder, 4, 12)
    return s.add({"f1": L.forward_log_return(s, "close", 1), "f4": L.forward_log_return(s, "close", 4), "f12": L.forward_log_return(s, "close", 12),
                  "bps4": L.forward_bps(s, "close", 4), "past4": 10_000.0 * F.ln(F.col("close") / R.lag(s, "close", 4)),
                  "pnl4": L.lead(s, "close", 4) / F.col("close") - 1 - 0.0008}).result("symbol", "bar", "f1", "f4", "f12", "bps4", "past4", "pnl4")


@query("forward_volatility", "M4 M5 M10 M19 M31", f"""WITH {_RET} SELECT symbol, bar, CASE WHEN count(r) OVER w = 12 THEN stddev_samp(r) OVER w END AS fvol, CASE WHEN count(r) OVER w = 12 THEN sum(r) OVER w END AS fsum,
 CASE WHEN count(low) OVER w = 12 THEN min(low) OVER w / close - 1 END AS mae, CASE WHEN count(low) OVER w = 12 THEN CASE WHEN min(low) OVER w / close - 1 <= -0.5 THEN 1.0 ELSE 0 END END AS bear,
 -((lead(close - open, 6) OVER {_ORD}) - (close - open)) AS convergence FROM x WINDOW w AS {_FW(1, 12)}""", "fvol fsum mae bear convergence")
def forward_volatility(spark, folder):
    s = ret_bars(spark, folder, 1, 12)
    w = s.rows(1, 12)
    mae = F.when(F.count("low").over(w) == 12, F.min("low").over(w) / F.col("close") - 1)
    b = F.col("close") - F.col("open")
    s = s.add({"fvol": L.future_volatility(s, "r", 12), "fsum": L.forward_sum(s, "r", 12), "mae": mae, "convergence": -(L.lead(s, b, 6) - b)})
    return s.add({"bear": F.when(F.col("mae").isNotNull(), flag(F.col("mae") <= -0.5))}).result("symbol", "bar", "fvol", "fsum", "mae", "bear", "convergence")


@query("next_price_move", "M6", f"""WITH {TICKS}, t AS (SELECT event_id, symbol, ts_us, floor(price / 20) AS p FROM ticks), c AS (SELECT *, row_number() OVER w AS i, CASE WHEN p IS DISTINCT FROM lag(p) OVER w THEN 1 ELSE 0 END AS opens FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM c), n AS (SELECT symbol, k - 1 AS k, min(p) AS np, min(i) AS ni FROM g GROUP BY 1, 2) SELECT event_id, sign(np - p) AS direction, ni - i AS steps FROM g LEFT JOIN n USING (symbol, k)""", "direction")
def next_price_move(spark, folder):
    t = ticks(spark, folder).select("event_id", "symbol", "ts_us", F.floor(F.col("price") / 20).cast("double").alias("p"))
    s = sequence(t, ["symbol"], ["ts_us", "event_id"], back=1)
    d = s.add({"opens": F.when(F.lag("p").over(s.by()).eqNullSafe(F.col("p")), 0).otherwise(1)}).result()
    # stretches of one price, numbered within the symbol; the next move is the first row of the next stretch, however far
    d = pin(running_total(d, ["symbol"], ["ts_us", "event_id"], {"k": F.col("opens"), "i": F.lit(1)}, 7 * DAY_US).select("event_id", "symbol", "p", "k", "i"))
    n = d.groupBy("symbol", (F.col("k") - 1).alias("k")).agg(F.min("p").alias("np"), F.min("i").alias("ni"))
    return d.join(n, ["symbol", "k"], "left").select("event_id", F.signum(F.col("np") - F.col("p")).alias("direction"), (F.col("ni") - F.col("i")).alias("steps"))



_BAR = f"""WITH {_RET}, y AS (SELECT symbol, bar, close, list(struct_pack(h := high, l := low, c := close)) OVER {_FW(1, 12)} AS f, avg(high - low) OVER {_W(13)} AS atr FROM x)"""
_POS = lambda cond: f"coalesce(list_position(list_transform(f, lambda q: {cond}), true), 0)"


def _future_bars(spark, folder, n=12):
    s = ret_bars(spark, folder, 14, n)
    return s.add({"f": L.next_rows(s, n, h="high", l="low", c="close"), "atr": R.mean(s, F.col("high") - F.col("low"), 14, 1)})


@query("triple_barrier", "M12 M13 M32", _BAR + f""", z AS (SELECT *, {_POS('q.h >= close + 1.5 * atr')} AS a, {_POS('q.l <= close - 1.0 * atr')} AS b FROM y)
SELECT symbol, bar, CASE WHEN len(f) = 12 THEN CASE WHEN a > 0 AND (b = 0 OR a <= b) THEN 1 WHEN b > 0 THEN -1 ELSE 0 END END AS label, nullif(a, 0) AS to_target, nullif(b, 0) AS to_stop FROM z""")
def triple_barrier(spark, folder):
    s = _future_bars(spark, folder)
    up, down = F.col("close") + 1.5 * F.col("atr"), F.col("close") - F.col("atr")
    return s.result("symbol", "bar", L.barrier(s, 12, F.col("f"), up, down).alias("label"), L.time_to(F.col("f"), lambda r: r["h"] >= up).alias("to_target"),
                    L.time_to(F.col("f"), lambda r: r["l"] <= down).alias("to_stop"))


@query("volatility_barrier", "M14", f"""WITH {_RET}, y AS (SELECT symbol, bar, close, list(close) OVER {_FW(1, 12)} AS f, CASE WHEN count(r) OVER v >= 8 THEN stddev_samp(r) OVER v END AS vol FROM x WINDOW v AS {_W(23)}),
z AS (SELECT *, {_POS('q >= close * exp(vol)')} AS a, {_POS('q <= close * exp(-vol)')} AS b FROM y WHERE vol IS NOT NULL)
SELECT symbol, bar, CASE WHEN len(f) = 12 THEN CASE WHEN a > 0 AND (b = 0 OR a <= b) THEN 1 WHEN b > 0 THEN -1 ELSE 0 END END AS label,
 CASE WHEN len(f) = 12 THEN CASE WHEN a > 0 AND b > 0 THEN least(a, b) WHEN a + b > 0 THEN a + b ELSE 12 END END AS held,
 CASE WHEN len(f) = 12 THEN ln(f[CASE WHEN a > 0 AND b > 0 THEN least(a, b) WHEN a + b > 0 THEN a + b ELSE 12 END] / close) - 0.0008 END AS net, coalesce(len(f), 0) < 12 AS censored FROM z""", "net")
def volatility_barrier(spark, folder):
    s = ret_bars(spark, folder, 26, 12)
    s = s.add({"f": L.next_rows(s, 12, h="close", l="close"), "vol": R.std(s, "r", 24, 8)})
    f, up, down = F.col("f"), F.col("close") * F.exp("vol"), F.col("close") * F.exp(-F.col("vol"))
    a, b = L.first_place(f, lambda r: r["h"] >= up), L.first_place(f, lambda r: r["l"] <= down)
    held = F.when((a > 0) & (b > 0), F.least(a, b)).when(a + b > 0, a + b).otherwise(12)
    full = F.size(f) == 12
    d = s.result("symbol", "bar", "close", "vol", "f", L.barrier(s, 12, f, up, down).alias("label"), F.when(full, held).cast("bigint").alias("held"), (~full).alias("censored"))
    d = d.where(F.col("vol").isNotNull())
    return d.select("symbol", "bar", "label", "held", (F.ln(F.try_element_at("f", F.col("held").cast("int"))["h"] / F.col("close")) - 0.0008).alias("net"), "censored")


_LT, _LS = repr(math.log(1.3)), repr(math.log(0.8))


@query("economic_labels", "M16 M17", _BAR + f""", z AS (SELECT *, {_POS('q.h >= close * 1.3')} AS lw, {_POS('q.l <= close * 0.8')} AS ll, {_POS('q.l <= close * 0.7')} AS sw, {_POS('q.h >= close * 1.2')} AS sl FROM y)
SELECT symbol, bar, CASE WHEN len(f) = 12 THEN CASE WHEN lw > 0 AND (ll = 0 OR lw < ll) THEN {_LT} WHEN ll > 0 THEN {_LS} ELSE ln(f[12].c / close) END - 0.001 END AS long_pnl,
 CASE WHEN len(f) = 12 THEN CASE WHEN sw > 0 AND (sl = 0 OR sw < sl) THEN {_LT} WHEN sl > 0 THEN {_LS} ELSE -ln(f[12].c / close) END - 0.001 END AS short_pnl FROM z""", "long_pnl short_pnl")
def economic_labels(spark, folder):
    s = _future_bars(spark, folder)
    side = lambda k: L.economic_side(F.col("f"), 12, F.col("close"), 0.3, 0.2, 0.001, k)
    return s.result("symbol", "bar", side(1).alias("long_pnl"), side(-1).alias("short_pnl"))


@query("label_family", "M11", f"""WITH {_RET} SELECT symbol, bar, coalesce(lead(close, 5) OVER {_ORD} / (close + 1e-12), 1) - 1 AS future_return, sign(lead(close, 5) OVER {_ORD} - close) AS direction,
 max(high) OVER w / close - 1 AS max_up, min(low) OVER w / close - 1 AS max_down, CASE WHEN max(high) OVER w > max(high) OVER {_W(19)} THEN 1.0 ELSE 0 END AS breakout FROM x WINDOW w AS {_FW(1, 5)}""", "future_return direction max_up max_down breakout")
def label_family(spark, folder):
    s = ret_bars(spark, folder, 20, 5)
    w = s.rows(1, 5)
    nxt = L.lead(s, "close", 5)
    return s.add({"future_return": F.coalesce(nxt / (F.col("close") + 1e-12), F.lit(1.0)) - 1, "direction": F.signum(nxt - F.col("close")),
                  "max_up": F.max("high").over(w) / F.col("close") - 1, "max_down": F.min("low").over(w) / F.col("close") - 1,
                  "breakout": flag(F.max("high").over(w) > R.high(s, "high", 20, 1))}).result("symbol", "bar", "future_return", "direction", "max_up", "max_down", "breakout")


@query("embargo_mask", "M15", f"""WITH {_RET} SELECT symbol, bar, coalesce(max(CASE WHEN abs(r) > 2 THEN i END) OVER {_W(6)} IS NULL, true) AS usable FROM x""")
def embargo_mask(spark, folder):
    s = ret_bars(spark, folder, 6)
    return s.add({"usable": F.coalesce(F.max(ind(F.abs("r") > 2)).over(s.rows(-6, 0)) == 0, F.lit(True))}).result("symbol", "bar", "usable")


_TREND = f"""WITH {_RET}, y AS (SELECT *, ln(lead(close, 12) OVER {_ORD} / close) AS fr, CASE WHEN count(r) OVER v >= 8 THEN stddev_samp(r) OVER v * sqrt(8760) END AS vol FROM x WINDOW v AS {_W(23)})"""


def _trend(spark, folder):
    s = ret_bars(spark, folder, 26, 12)
    return s.add({"fr": L.forward_log_return(s, "close", 12), "vol": R.std(s, "r", 24, 8) * math.sqrt(8760)}).result("symbol", "bar", "close", "volume", "r", "fr", "vol")


@query("trend_labels", "M22 M26 M29 M30 M20", _TREND + """ SELECT symbol, bar, CASE WHEN fr IS NOT NULL AND vol IS NOT NULL THEN CASE WHEN abs(fr) > 0.5 * vol * sqrt(12 / 8760.0) + 0.0008 THEN sign(fr) ELSE 0 END END AS label,
 CASE WHEN vol IS NULL THEN NULL WHEN fr > 0.2 THEN 'LONGABLE' WHEN fr < -0.2 THEN 'SHORTABLE' ELSE 'NEUTRAL' END AS regime FROM y""", "label")
def trend_labels(spark, folder):
    d = _trend(spark, folder)
    fr = F.col("fr")
    regime = F.when(F.col("vol").isNull(), None).when(fr > 0.2, "LONGABLE").when(fr < -0.2, "SHORTABLE").otherwise("NEUTRAL")
    return d.select("symbol", "bar", L.trend_label(fr, F.col("vol"), 12, 0.5, 8.0, 8760.0).alias("label"), regime.alias("regime"))


@query("trend_label_shares", "M24", _TREND + """, l AS (SELECT symbol, CASE WHEN abs(fr) > 0.5 * vol * sqrt(12 / 8760.0) + 0.0008 THEN sign(fr) ELSE 0 END AS label FROM y WHERE fr IS NOT NULL AND vol IS NOT NULL)
SELECT symbol, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0 END) AS flat, avg(CASE WHEN label = -1 THEN 1.0 ELSE 0 END) AS down FROM l GROUP BY symbol""", "up flat down")
def trend_label_shares(spark, folder):
    d = _trend(spark, folder).withColumn("label", L.trend_label(F.col("fr"), F.col("vol"), 12, 0.5, 8.0, 8760.0)).where(F.col("label").isNotNull())
    return d.groupBy("symbol").agg(*[F.avg(ind(F.col("label") == v)).alias(k) for k, v in (("up", 1), ("flat", 0), ("down", -1))])


@query("flat_share_k", "M23", _TREND + " SELECT symbol, quantile_cont((abs(fr) - 0.0008) / (vol * sqrt(12 / 8760.0)), 0.4) AS k FROM y WHERE fr IS NOT NULL AND vol > 0 GROUP BY symbol", "k")
def flat_share_k(spark, folder):
    d = _trend(spark, folder).where("fr is not null and vol > 0")
    d = d.withColumn("x", (F.abs("fr") - 0.0008) / (F.col("vol") * math.sqrt(12 / 8760.0)))
    return exact_quantiles(d, ["symbol"], "x", {"k": 0.4})


@query("net_carry_label", "M25", _TREND + """, z AS (SELECT symbol, bar, abs(r) * 12 / 8.0 - abs(fr) * 0.1 - 0.01 AS carry FROM y WHERE r IS NOT NULL AND fr IS NOT NULL)
SELECT symbol, bar, carry, CASE WHEN carry > 0.005 THEN 1 WHEN carry < -0.01 THEN -1 ELSE 0 END AS label FROM z""", "carry")
def net_carry_label(spark, folder):
    d = _trend(spark, folder).where("r is not null and fr is not null")
    d = d.withColumn("carry", L.net_carry(F.col("r"), F.abs("fr") * 0.1, 12.0, 0.01))
    return d.select("symbol", "bar", "carry", F.when(F.col("carry") > 0.005, 1).when(F.col("carry") < -0.01, -1).otherwise(0).alias("label"))


@query("quantile_labels", "M18 M27", _TREND + f""", q AS (SELECT symbol, quantile_cont(fr, 0.7) AS hi, quantile_cont(fr, 0.3) AS lo FROM y WHERE fr IS NOT NULL AND bar % (10 * {DAY_US}) < 6 * {DAY_US} GROUP BY symbol)
SELECT y.symbol, y.bar, CASE WHEN fr >= hi THEN 1 WHEN fr <= lo THEN 0 ELSE -1 END AS label FROM y JOIN q ON q.symbol = y.symbol WHERE fr IS NOT NULL""")
def quantile_labels(spark, folder):
    d = _trend(spark, folder).where("fr is not null")
    q = exact_quantiles(d.where(F.pmod("bar", F.lit(10 * DAY_US)) < 6 * DAY_US), ["symbol"], "fr", {"hi": 0.7, "lo": 0.3})
    return d.join(q, "symbol").select("symbol", "bar", F.when(F.col("fr") >= F.col("hi"), 1).when(F.col("fr") <= F.col("lo"), 0).otherwise(-1).alias("label"))


@query("event_path_labels", "M33 M34 C22 C21", f"""WITH {_RET}, ev AS (SELECT event_id, symbol, ts_us, CASE WHEN is_sell THEN -1 ELSE 1 END AS dir FROM ticks WHERE kind = 'purchase'),
b AS (SELECT symbol, bar, open, r, i FROM x), e AS (SELECT ev.*, b.bar AS entry, b.open AS entry_price, b.i FROM ev ASOF LEFT JOIN b ON b.symbol = ev.symbol AND ev.ts_us <= b.bar),
p AS (SELECT e.event_id, e.dir, b.i - e.i + 1 AS k, b.r, sum(b.r * e.dir) OVER (PARTITION BY e.event_id ORDER BY b.i) AS path FROM e JOIN b ON b.symbol = e.symbol AND b.i BETWEEN e.i AND e.i + 7),
a AS (SELECT event_id, count(r) AS n, max(path) AS top, min(path) AS bottom, arg_max(path, k) AS fin FROM p GROUP BY event_id)
SELECT e.event_id, e.entry_price, 2 * 0.0005 + 2 * 0.01 / e.entry_price AS cost, CASE WHEN n = 8 THEN exp(fin) - 1 END AS ret, CASE WHEN n = 8 THEN exp(greatest(top, 0)) - 1 END AS mfe, CASE WHEN n = 8 THEN exp(least(bottom, 0)) - 1 END AS mae,
 coalesce(n = 8, false) AS complete FROM e LEFT JOIN a ON a.event_id = e.event_id""", "entry_price cost ret mfe mae")
def event_path_labels(spark, folder):
    s = ret_bars(spark, folder, 1, 8)
    b = s.result("symbol", "bar", "open", "r")
    b = running_total(b, ["symbol"], ["bar"], {"cum": F.col("r")}, 60 * DAY_US)
    s = sequence(b, ["symbol"], ["bar"], ahead=8, bound=HOURS)
    path = s.add(L.path_columns(s, "r", "cum", 8)).result("symbol", "bar", "open", "end", "top", "bottom")
    ev = ticks(spark, folder).where("kind = 'purchase'").select("event_id", "symbol", "ts_us", F.when(F.col("is_sell"), -1.0).otherwise(1.0).alias("dir"))
    d = asof_join(ev, path, by=["symbol"], left_clock="ts_us", right_clock="bar", cols=["open", "end", "top", "bottom"], prefix="p_", direction="forward")
    up = F.col("dir") > 0
    best = F.when(up, F.col("p_top")).otherwise(-F.col("p_bottom"))
    worst = F.when(up, F.col("p_bottom")).otherwise(-F.col("p_top"))
    return d.select("event_id", F.col("p_open").alias("entry_price"), L.event_cost(F.col("p_open"), 0.01, 0.0005).alias("cost"),
                    F.expm1(F.col("p_end") * F.col("dir")).alias("ret"), F.expm1(best).alias("mfe"), F.expm1(worst).alias("mae"), F.col("p_end").isNotNull().alias("complete"))


@query("outcome_labels", "M35 M36 O26", f"""WITH {TICKS}, q AS (SELECT * FROM ticks WHERE kind = 'view'), d AS (SELECT event_id, symbol, ts_us, ts_us + {6 * HOUR_US} AS exit_us, CASE WHEN is_sell THEN -1 ELSE 1 END AS side FROM ticks WHERE kind = 'purchase'),
a AS (SELECT d.*, q.price AS p0 FROM d ASOF LEFT JOIN q ON q.symbol = d.symbol AND d.ts_us >= q.ts_us), b AS (SELECT a.*, q.price AS p1 FROM a ASOF LEFT JOIN q ON q.symbol = a.symbol AND a.exit_us >= q.ts_us),
m AS (SELECT *, 10000 * ln(p1 / p0) AS raw FROM b), u AS (SELECT ts_us // {DAY_US} AS day, avg(raw) AS mkt FROM m GROUP BY 1)
SELECT event_id, side * raw AS gross_bps, side * raw - 8 AS net_bps, side * (raw - mkt) AS excess_bps FROM m JOIN u ON u.day = m.ts_us // {DAY_US}""", "gross_bps net_bps excess_bps", digits=4)
def outcome_labels(spark, folder):
    t = ticks(spark, folder)
    q = t.where("kind = 'view'").select("symbol", "ts_us", "event_id", "price")
    d = t.where("kind = 'purchase'").select("event_id", "symbol", "ts_us", (F.col("ts_us") + 6 * HOUR_US).alias("exit_us"), F.when(F.col("is_sell"), -1.0).otherwise(1.0).alias("side"))
    d = asof_join(d, q, by=["symbol"], left_clock="ts_us", right_clock="ts_us", cols=["price"], prefix="a_", tie=["event_id"])
    d = asof_join(d, q, by=["symbol"], left_clock="exit_us", right_clock="ts_us", cols=["price"], prefix="b_", tie=["event_id"])
    d = d.withColumns({"raw": 10_000.0 * F.ln(F.col("b_price") / F.col("a_price")), "day": F.floor(F.col("ts_us") / DAY_US)})
    d = d.join(d.groupBy("day").agg(F.avg("raw").alias("mkt")), "day")
    s = F.col("side")
    return d.select("event_id", (s * F.col("raw")).alias("gross_bps"), (s * F.col("raw") - 8).alias("net_bps"), (s * (F.col("raw") - F.col("mkt"))).alias("excess_bps"))


@query("stop_aware_return", "M38", f"""WITH {_RET}, e AS (SELECT symbol, bar, close, min(low) OVER {_FW(1, 12)} AS worst, lead(close, 12) OVER {_ORD} AS last, r FROM x)
SELECT symbol, bar, CASE WHEN worst <= close * 0.5 THEN -0.5 ELSE last / close - 1 END - 0.001 AS ret FROM e WHERE r < -1 AND last IS NOT NULL""", "ret")
def stop_aware_return(spark, folder):
    s = ret_bars(spark, folder, 1, 12)
    s = s.add({"worst": F.min("low").over(s.rows(1, 12)), "last": L.lead(s, "close", 12)})
    d = s.result().where("r < -1 and last is not null")
    return d.select("symbol", "bar", (F.when(F.col("worst") <= F.col("close") * 0.5, -0.5).otherwise(F.col("last") / F.col("close") - 1) - 0.001).alias("ret"))


@query("exit_samples", "M39", f"""WITH {_RET}, e AS (SELECT symbol, i, bar, close FROM x), b AS (SELECT symbol, i, close FROM x),
p AS (SELECT e.symbol, e.bar, b.i - e.i AS held, b.close / e.close - 1 AS pnl FROM e JOIN b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 1 AND e.i + 6)
SELECT symbol, bar, held, pnl, pnl >= max(pnl) OVER (PARTITION BY symbol, bar ORDER BY held ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_best FROM p""", "pnl")
def exit_samples(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "close"), ["symbol"], ["bar"], ahead=6, bound=HOURS)
    s = s.add({"f": L.next_rows(s, 6, p="close")})
    d = s.result().select("symbol", "bar", "close", F.posexplode("f").alias("pos", "x"), "f")
    rest = F.array_max(F.transform(F.expr("slice(f, pos + 1, 6)"), lambda r: r["p"]))
    return d.select("symbol", "bar", (F.col("pos") + 1).cast("bigint").alias("held"), (F.col("x.p") / F.col("close") - 1).alias("pnl"), (F.col("x.p") >= rest).alias("is_best"))


@query("purged_split", "M41 M42", f"""WITH {PANEL}, d AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS y FROM panel),
f AS (SELECT symbol, min(i) FILTER (y = 1999) AS v0, min(i) FILTER (y >= 2000) AS t0 FROM d GROUP BY symbol)
SELECT d.symbol, d.day, CASE WHEN y <= 1998 THEN CASE WHEN i < v0 - 30 THEN 'train' ELSE 'purged' END WHEN y = 1999 THEN CASE WHEN i < t0 - 30 THEN 'val' ELSE 'purged' END ELSE 'test' END AS part FROM d JOIN f ON f.symbol = d.symbol""")
def purged_split(spark, folder):
    d = number_rows(panel(spark, folder).select("symbol", "day"), ["symbol"], ["day"], 1000).withColumnRenamed(RN, "i")
    d = d.withColumn("y", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))))
    f = d.groupBy("symbol").agg(F.min(F.when(F.col("y") == 1999, F.col("i"))).alias("v0"), F.min(F.when(F.col("y") >= 2000, F.col("i"))).alias("t0"))
    part = F.when(F.col("y") <= 1998, F.when(F.col("i") < F.col("v0") - 30, "train").otherwise("purged")).when(
        F.col("y") == 1999, F.when(F.col("i") < F.col("t0") - 30, "val").otherwise("purged")).otherwise("test")
    return d.join(f, "symbol").select("symbol", "day", part.alias("part"))
