"""Order books, trade flow, venues, wallets, options and accounting tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, div, flag, ind
from tidemark.operators import micro as M
from tidemark.operators import portfolio as P
from tidemark.operators import rolling as R
from tidemark.operators.asof import Context, asof_contexts, asof_join, window_sums
from tidemark.operators.blocks import HOURS, running_total, sequence
from tidemark.operators.crosssection import average_rank, exact_quantiles
from tidemark.operators.events import greedy_anchors
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, TICKS, bars, decisions, panel, read, ticks

SIX = 6 * HOUR_US
_LV = f"""{TICKS}, q AS (SELECT symbol, ts_us // {DAY_US} AS slot, is_sell, CASE WHEN is_sell THEN 101 + floor(price) % 50 ELSE 100 - floor(price) % 50 END AS price, sum(qty)::DOUBLE AS qty FROM ticks GROUP BY 1, 2, 3, 4),
b AS (SELECT symbol, slot, list({{'price': price, 'qty': qty}} ORDER BY price DESC) FILTER (NOT is_sell) AS bids, list({{'price': price, 'qty': qty}} ORDER BY price) FILTER (is_sell) AS asks FROM q GROUP BY 1, 2)"""


def levels(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.floor(F.col("ts_us") / DAY_US))
    cell = F.floor("price") % 50
    t = t.withColumn("level", F.when(F.col("is_sell"), 101 + cell).otherwise(100 - cell).cast("double"))
    t = t.groupBy("symbol", "slot", "is_sell", "level").agg(F.sum("qty").cast("double").alias("qty"))
    return t.groupBy("symbol", "slot").agg(M.sorted_levels("level", "qty", ~F.col("is_sell"), True).alias("bids"), M.sorted_levels("level", "qty", F.col("is_sell"), False).alias("asks"))


_SUMQ = lambda l: f"coalesce(list_sum(list_transform({l}, lambda v: v.qty)), 0)"


@query("book_vector", "J6 J7 J35", f"""WITH {_LV}, m AS (SELECT *, (bids[1].price + asks[1].price) / 2 AS mid FROM b WHERE len(bids) > 0 AND len(asks) > 0)
SELECT symbol, slot, mid, (asks[1].price - bids[1].price) / mid * 10000 AS spread_bps, ((asks[1].price * bids[1].qty + bids[1].price * asks[1].qty) / (bids[1].qty + asks[1].qty) / mid - 1) * 10000 AS micro_offset_bps,
 (bids[1].qty - asks[1].qty) / (bids[1].qty + asks[1].qty) AS imbalance_1, ({_SUMQ('bids[1:5]')} - {_SUMQ('asks[1:5]')}) / ({_SUMQ('bids[1:5]')} + {_SUMQ('asks[1:5]')}) AS imbalance_5,
 {_SUMQ('list_filter(bids, lambda v: abs(v.price / mid - 1) * 10000 <= 500)')} AS bid_depth, {_SUMQ('list_filter(asks, lambda v: abs(v.price / mid - 1) * 10000 <= 500)')} AS ask_depth,
 coalesce(list_sum(list_transform(list_filter(asks, lambda v: v.price <= mid * 1.05), lambda v: v.price * v.qty)), 0) AS notional_up,
 list_sum(list_transform(list_concat(bids, asks), lambda v: abs(v.price / mid - 1) * 10000 * v.qty)) / {_SUMQ('list_concat(bids, asks)')} AS weighted_distance_bps FROM m""",
       "mid spread_bps micro_offset_bps imbalance_1 imbalance_5 bid_depth ask_depth notional_up weighted_distance_bps", digits=4)
def book_vector(spark, folder):
    d = levels(spark, folder).where((F.size("bids") > 0) & (F.size("asks") > 0))
    # 1e-9 on the band keeps levels that sit exactly on its edge.
    return d.select("symbol", "slot", *[v.alias(k) for k, v in M.book_vector(F.col("bids"), F.col("asks"), 500.0, 500.0).items()])


@query("top_of_book_flow", "J8 J5", f"""WITH {_LV}, t AS (SELECT symbol, slot, bids[1].price AS pb, bids[1].qty AS qb, asks[1].price AS pa, asks[1].qty AS qa FROM b WHERE len(bids) > 0 AND len(asks) > 0), l AS (SELECT *, lag(pb) OVER w AS pb0, lag(qb) OVER w AS qb0, lag(pa) OVER w AS pa0, lag(qa) OVER w AS qa0 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY slot))
SELECT symbol, slot, CASE WHEN pb >= pb0 THEN qb ELSE 0 END - CASE WHEN pb <= pb0 THEN qb0 ELSE 0 END - CASE WHEN pa <= pa0 THEN qa ELSE 0 END + CASE WHEN pa >= pa0 THEN qa0 ELSE 0 END AS ofi FROM l""", "ofi")
def top_of_book_flow(spark, folder):
    d = levels(spark, folder).where((F.size("bids") > 0) & (F.size("asks") > 0))
    b, a = F.element_at("bids", 1), F.element_at("asks", 1)
    d = d.select("symbol", "slot", b["price"].alias("pb"), b["qty"].alias("qb"), a["price"].alias("pa"), a["qty"].alias("qa"))
    s = sequence(d, ["symbol"], ["slot"], back=1)
    return s.add({"ofi": M.top_ofi(s, "pb", "qb", "pa", "qa")}).result("symbol", "slot", "ofi")


@query("removal_imbalances", "J9 J10", f"""WITH {TICKS}, e AS (SELECT symbol, ts_us // {SIX} AS slot, is_sell, kind, price * qty AS n FROM ticks) SELECT symbol, slot, coalesce((sum(n) FILTER (kind = 'error' AND is_sell) - coalesce(sum(n) FILTER (kind = 'click'), 0)) / nullif(sum(n) FILTER (kind IN ('error', 'click')), 0), CASE WHEN sum(n) FILTER (kind = 'click') > 0 THEN -1.0 ELSE 0 END) AS cancel,
 coalesce((coalesce(sum(n) FILTER (is_sell), 0) - coalesce(sum(n) FILTER (NOT is_sell), 0)) / nullif(sum(n), 0), 0) AS removal FROM e GROUP BY 1, 2""", "cancel removal")
def removal_imbalances(spark, folder):
    t = ticks(spark, folder).withColumns({"slot": F.floor(F.col("ts_us") / SIX), "n": F.col("price") * F.col("qty")})
    side = lambda cond: F.sum(ind(cond, F.col("n")))
    ask, bid = side(F.col("kind") == "error"), side(F.col("kind") == "click")
    return t.groupBy("symbol", "slot").agg(F.coalesce(div(ask - bid, ask + bid), F.lit(0.0)).alias("cancel"),
                                           F.coalesce(div(side(F.col("is_sell")) - side(~F.col("is_sell")), F.sum("n")), F.lit(0.0)).alias("removal"))


@query("trade_flow_features", "J11 J14", f"""WITH {TICKS}, t AS (SELECT *, ts_us // {DAY_US} AS slot, price * qty AS usd FROM ticks), g AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY symbol, slot ORDER BY ts_us, event_id)) / 1e6 AS gap FROM t),
a AS (SELECT symbol, slot, count(*) AS n, sum(CASE WHEN is_sell THEN -usd ELSE usd END) AS signed, sum(usd) AS gross, 10000 * ln(arg_max(price, (ts_us, event_id)) / arg_min(price, (ts_us, event_id))) AS move_bps, (max(ts_us) - min(ts_us)) / 1e6 AS span, stddev_pop(gap) / nullif(avg(gap), 0) AS gap_cv FROM g GROUP BY 1, 2)
SELECT symbol, slot, n, signed, gross, move_bps, gap_cv, coalesce(signed / nullif(gross, 0), 0) AS imbalance, move_bps * 1e6 / nullif(abs(signed), 0) AS impact_per_million, gross / (abs(move_bps) + 1) AS absorption, n / nullif(span, 0) AS rate FROM a""", "signed gross move_bps gap_cv imbalance impact_per_million absorption rate", digits=4)
def trade_flow_features(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.floor(F.col("ts_us") / DAY_US))
    return M.trade_flow(t, ["symbol", "slot"], "ts_us", ["ts_us", "event_id"], F.col("price") * F.col("qty"), F.col("is_sell"), "price")


@query("grid_trade_windows", "J15 J17 F22", f"""WITH {TICKS}, g AS (SELECT DISTINCT symbol, ts_us - ts_us % {SIX} AS slot FROM ticks) SELECT g.symbol, g.slot, CAST(count(t.event_id) AS BIGINT) AS n, coalesce(sum(price * qty), 0) AS gross, coalesce(sum(CASE WHEN is_sell THEN -price * qty ELSE price * qty END), 0) AS signed,
 coalesce(sum(CASE WHEN is_sell THEN -price * qty ELSE price * qty END) / nullif(sum(price * qty), 0), 0) AS imbalance, count(t.event_id) / 86400.0 AS rate FROM g LEFT JOIN ticks t ON t.symbol = g.symbol AND t.ts_us > g.slot - {DAY_US} AND t.ts_us <= g.slot GROUP BY 1, 2""", "gross signed imbalance rate", digits=3)
def grid_trade_windows(spark, folder):
    t = ticks(spark, folder)
    g = t.select("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(SIX))).alias("slot")).distinct()
    # Amounts in whole hundredths: running sums of integers leave no rounding residue when a window empties.
    cents = F.round(F.col("price") * F.col("qty") * 100).cast("bigint")
    d = M.grid_flow(g, t, ["symbol"], "slot", "ts_us", DAY_US, cents, F.col("is_sell"))
    return d.select("symbol", "slot", F.col("n").cast("bigint").alias("n"), (F.col("gross") / 100).alias("gross"), (F.col("signed") / 100).alias("signed"), "imbalance", "rate")


@query("last_n_trade_windows", "J16", f"""WITH {TICKS}, t AS (SELECT *, price * qty AS usd, CASE WHEN is_sell THEN -price * qty ELSE price * qty END AS sg FROM ticks), f AS (SELECT event_id, symbol, ts_us, sum(sg) OVER w AS flow, sum(sg) OVER w / nullif(sum(usd) OVER w, 0) AS imbalance, CAST(count(*) FILTER (usd >= 3000) OVER w AS DOUBLE) / 20 AS large, count(*) OVER w AS k FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id ROWS 19 PRECEDING))
SELECT event_id, imbalance, large, flow - lag(flow) OVER o AS acceleration, flow - 2 * lag(flow) OVER o + lag(flow, 2) OVER o AS jerk FROM f WINDOW o AS (PARTITION BY symbol ORDER BY ts_us, event_id)""", "imbalance large acceleration jerk", digits=4)
def last_n_trade_windows(spark, folder):
    usd = F.col("price") * F.col("qty")
    t = ticks(spark, folder).select("event_id", "symbol", "ts_us", usd.alias("usd"), F.when(F.col("is_sell"), -usd).otherwise(usd).alias("sg"))
    s = sequence(t, ["symbol"], ["ts_us", "event_id"], back=22)
    w = s.rows(-19, 0)
    s = s.add({"flow": F.sum("sg").over(w), "imbalance": div(F.sum("sg").over(w), F.sum("usd").over(w)), "large": F.sum(ind(F.col("usd") >= 3000)).over(w) / 20})
    return s.add({"acceleration": R.change(s, "flow"), "jerk": F.col("flow") - 2 * R.lag(s, "flow") + R.lag(s, "flow", 2)}).result("event_id", "imbalance", "large", "acceleration", "jerk")


@query("resilience_time", "J12", f"""WITH {BARS}, y AS (SELECT symbol, bar, volume, avg(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM bars), d AS (SELECT symbol, min(bar) FILTER (volume <= 0.5 * base) AS low_at, arg_min(base, bar) FILTER (volume <= 0.5 * base) AS b0 FROM y GROUP BY 1)
SELECT d.symbol, low_at, (min(y.bar) FILTER (y.bar > low_at AND y.volume >= 0.9 * b0) - max(low_at)) / 1e6 AS seconds FROM d JOIN y ON y.symbol = d.symbol GROUP BY 1, 2""", "seconds")
def resilience_time(spark, folder):
    s = sequence(bars(spark, folder).select("symbol", "bar", "volume"), ["symbol"], ["bar"], back=10, bound=HOURS)
    y = s.add({"base": F.avg("volume").over(s.rows(-10, -1))}).result()
    low = F.col("volume") <= 0.5 * F.col("base")
    d = y.groupBy("symbol").agg(F.min(F.when(low, F.col("bar"))).alias("low_at"), F.min_by("base", F.when(low, F.col("bar"))).alias("b0"))
    back = (F.col("bar") > F.col("low_at")) & (F.col("volume") >= 0.9 * F.col("b0"))
    d = y.join(d, "symbol").groupBy("symbol", "low_at").agg(F.min(F.when(back, F.col("bar"))).alias("up_at"))
    return d.select("symbol", "low_at", ((F.col("up_at") - F.col("low_at")) / 1e6).alias("seconds"))


_SYNC = f"""{TICKS}, g AS (SELECT DISTINCT symbol, ts_us - ts_us % {SIX} + {SIX} AS slot FROM ticks), v AS (SELECT unnest([0, 1, 2]) AS venue), gv AS (SELECT symbol, slot, venue FROM g CROSS JOIN v),
j AS (SELECT gv.*, t.price, t.ts_us, gv.slot - t.ts_us AS age FROM gv ASOF LEFT JOIN ticks t ON t.symbol = gv.symbol AND t.venue = gv.venue AND gv.slot >= t.ts_us)"""


@query("synchronised_venues", "J1 J3 J4 A8", f"""WITH {_SYNC} SELECT symbol, slot, count(*) FILTER (price IS NOT NULL AND age <= {DAY_US}) AS n_ready, avg(price) FILTER (age <= {DAY_US}) AS mid, max(ts_us) FILTER (age <= {DAY_US}) - min(ts_us) FILTER (age <= {DAY_US}) AS span_us,
 count(*) FILTER (price IS NULL) AS no_book, count(*) FILTER (age > {DAY_US}) AS stale FROM j GROUP BY 1, 2""", "mid")
def synchronised_venues(spark, folder):
    t = ticks(spark, folder)
    g = t.select("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(SIX)) + SIX).alias("slot")).distinct()
    sides = [Context(t.where(F.col("venue") == k), "ts_us", ["price"], f"v{k}_", ["event_id"]) for k in (0, 1, 2)]
    d = asof_contexts(g, sides, by=["symbol"], left_clock="slot")
    rows = F.array(*[F.struct(F.col(f"v{k}_price").alias("p"), F.col(f"v{k}_ts_us").alias("t")) for k in (0, 1, 2)])
    d = d.select("symbol", "slot", rows.alias("v"))
    fresh = F.filter("v", lambda x: F.coalesce(F.col("slot") - x["t"] <= DAY_US, F.lit(False)))
    d = d.withColumn("ok", fresh)
    n = F.size("ok")
    clocks = F.transform("ok", lambda x: x["t"])
    return d.select("symbol", "slot", n.cast("bigint").alias("n_ready"), F.when(n > 0, F.aggregate("ok", F.lit(0.0), lambda a, x: a + x["p"]) / n).alias("mid"),
                    (F.array_max(clocks) - F.array_min(clocks)).alias("span_us"), F.size(F.filter("v", lambda x: x["t"].isNull())).cast("bigint").alias("no_book"),
                    F.size(F.filter("v", lambda x: F.col("slot") - x["t"] > DAY_US)).cast("bigint").alias("stale"))


@query("venue_dislocation", "J21 J22 C20", f"""WITH {_SYNC}, w AS (SELECT symbol, slot, 10000 * ln(max(price) FILTER (venue = 0) / max(price) FILTER (venue = 1)) AS gap FROM j GROUP BY 1, 2), z AS (SELECT *, CASE WHEN count(gap) OVER p >= 10 THEN (gap - avg(gap) OVER p) / nullif(stddev_samp(gap) OVER p, 0) END AS z, list({{'g': gap, 's': slot}}) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS f FROM w WINDOW p AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, coalesce(list_position(list_transform(f, lambda q: q.g IS NOT NULL AND abs(q.g) <= 0.5 * abs(gap)), true), 0) AS k FROM z WHERE abs(z) >= 1 AND len(f) = 4)
SELECT symbol, slot, gap, z, f[CASE WHEN k > 0 THEN k ELSE 4 END].s AS exit_slot, abs(gap) - sign(gap) * f[CASE WHEN k > 0 THEN k ELSE 4 END].g AS gross_bps FROM x""", "gap z gross_bps", digits=4)
def venue_dislocation(spark, folder):
    t = ticks(spark, folder)
    g = t.select("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(SIX)) + SIX).alias("slot")).distinct()
    d = asof_contexts(g, [Context(t.where(F.col("venue") == k), "ts_us", ["price"], f"v{k}_", ["event_id"]) for k in (0, 1)], by=["symbol"], left_clock="slot")
    d = d.select("symbol", "slot", (1e4 * F.ln(F.col("v0_price") / F.col("v1_price"))).alias("gap"))
    s = sequence(d, ["symbol"], ["slot"], back=31, ahead=4)
    s = s.add({"z": R.prior_z(s, "gap", 30, 10), "f": F.collect_list(F.struct(F.col("gap").alias("g"), F.col("slot").alias("s"))).over(s.rows(1, 4))})
    k = F.array_position(F.transform("f", lambda q: F.coalesce(F.abs(q["g"]) <= 0.5 * F.abs("gap"), F.lit(False))), F.lit(True))
    d = s.result().where((F.abs("z") >= 1) & (F.size("f") == 4))
    out = F.element_at("f", F.when(k > 0, k).otherwise(4).cast("int"))
    return d.select("symbol", "slot", "gap", "z", out["s"].alias("exit_slot"), (F.abs("gap") - F.signum("gap") * out["g"]).alias("gross_bps"))


_BND = f"""{TICKS}, b AS (SELECT symbol, ts_us // {SIX} AS slot, 100 * (1 + qty % 5) AS bps, sum(price) AS n FROM ticks WHERE NOT is_sell GROUP BY 1, 2, 3), c AS (SELECT symbol, slot, bps, sum(n) OVER (PARTITION BY symbol, slot ORDER BY bps) AS cum FROM b)"""


@query("slippage_for_notional", "J26", f"""WITH {_BND}, p AS (SELECT *, coalesce(lag(bps) OVER w, 0) AS b0, coalesce(lag(cum) OVER w, 0) AS c0 FROM c WINDOW w AS (PARTITION BY symbol, slot ORDER BY bps)), h AS (SELECT symbol, slot, min(bps) AS bps FROM p WHERE cum >= 60 GROUP BY 1, 2), a AS (SELECT DISTINCT symbol, slot FROM c)
SELECT a.symbol, a.slot, b0 + (p.bps - b0) * (60 - c0) / (cum - c0) AS slippage_bps FROM a LEFT JOIN h ON h.symbol = a.symbol AND h.slot = a.slot LEFT JOIN p ON p.symbol = h.symbol AND p.slot = h.slot AND p.bps = h.bps""", "slippage_bps")
def slippage_for_notional(spark, folder):
    t = ticks(spark, folder).where(~F.col("is_sell")).withColumns({"slot": F.floor(F.col("ts_us") / SIX), "bps": 100 * (1 + F.col("qty") % 5)})
    b = t.groupBy("symbol", "slot", "bps").agg(F.sum("price").alias("n"))
    b = b.withColumn("cum", F.sum("n").over(Window.partitionBy("symbol", "slot").orderBy("bps")))  # at most five bands
    d = b.groupBy("symbol", "slot").agg(F.array_sort(F.collect_list(F.struct("bps", "cum"))).alias("bands"))
    return d.select("symbol", "slot", M.slippage(F.col("bands"), 60.0).alias("slippage_bps"))


@query("trade_spread_proxy", "J30 I41", f"""WITH {TICKS}, t AS (SELECT symbol, ts_us // {DAY_US} AS slot, price, is_sell FROM ticks) SELECT symbol, slot, median(price) AS mid, greatest((avg(price) FILTER (NOT is_sell) - avg(price) FILTER (is_sell)) / median(price) * 10000, 0) AS spread_bps, CASE WHEN count(*) >= 20 THEN quantile_cont(price, 0.9) END AS p90 FROM t GROUP BY 1, 2
 HAVING count(*) FILTER (is_sell) > 0 AND count(*) FILTER (NOT is_sell) > 0""", "mid spread_bps p90", digits=4)
def trade_spread_proxy(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.floor(F.col("ts_us") / DAY_US))
    p, sell = F.col("price"), F.col("is_sell")
    gap = F.avg(F.when(~sell, p)) - F.avg(F.when(sell, p))
    q = exact_quantiles(t, ["symbol", "slot"], "price", {"mid": 0.5, "q90": 0.9})
    d = t.groupBy("symbol", "slot").agg(gap.alias("gap"), F.count(F.lit(1)).alias("n")).where("gap is not null").join(q, ["symbol", "slot"])
    return d.select("symbol", "slot", "mid", F.greatest(F.col("gap") / F.col("mid") * 1e4, F.lit(0.0)).alias("spread_bps"), F.when(F.col("n") >= 20, F.col("q90")).alias("p90"))


@query("capacity_policy", "J33", f"""WITH {DECISIONS}, l AS (SELECT symbol, sum(abs(gross_bps)) AS vol, max(abs(gross_bps)) AS top, count(*) AS oi FROM decisions GROUP BY 1) SELECT d.id, CASE tier WHEN '1-URGENT' THEN oi * 0.01 WHEN '2-HIGH' THEN top WHEN '3-MEDIUM' THEN vol * 6 / 24.0 * 0.05 END AS notional FROM decisions d LEFT JOIN l ON l.symbol = d.symbol""", "notional")
def capacity_policy(spark, folder):
    d = decisions(spark, folder)
    size = F.abs("gross_bps")
    l = d.groupBy("symbol").agg(F.sum(size).alias("vol"), F.max(size).alias("top"), F.count(F.lit(1)).alias("oi"))
    policy = F.when(F.col("tier") == "1-URGENT", "oi").when(F.col("tier") == "2-HIGH", "top").when(F.col("tier") == "3-MEDIUM", "volume")
    return d.join(l, "symbol", "left").select("id", M.capacity(policy, F.col("oi"), F.col("top"), F.col("vol"), 6.0, 0.01, 0.05).alias("notional"))


@query("twap_users", "J34", f"""WITH {TICKS}, g AS (SELECT user_id, is_sell, (ts_us - lag(ts_us) OVER (PARTITION BY user_id, is_sell ORDER BY ts_us, event_id)) / 1e6 AS gap FROM ticks), a AS (SELECT user_id, is_sell, count(*) AS fills, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY 1, 2)
SELECT user_id, is_sell, fills, l[len(l) // 2 + 1] AS upper_median FROM a WHERE fills >= 4 AND l[len(l) // 2 + 1] BETWEEN 15 AND 80000""", "upper_median")
def twap_users(spark, folder):
    from tidemark.operators.crosssection import distinct_ranks
    s = sequence(ticks(spark, folder), ["user_id", "is_sell"], ["ts_us", "event_id"], back=1)
    d = s.add({"gap": (F.col("ts_us") - F.lag("ts_us").over(s.by())) / 1e6}).result("user_id", "is_sell", "gap")
    n = d.groupBy("user_id", "is_sell").agg(F.count(F.lit(1)).alias("fills")).where("fills >= 4")
    r = distinct_ranks(d, ["user_id", "is_sell"], "gap")
    k = F.floor(F.col("total") / 2)
    r = r.where((F.col("below") <= k) & (k < F.col("below") + F.col("n"))).select("user_id", "is_sell", F.col("gap").alias("upper_median"))
    return n.join(r, ["user_id", "is_sell"]).where(F.col("upper_median").between(15, 80000))


@query("modality_audit", "J36 J37 J38 J39 S9 S10 S17", f"""WITH {TICKS}, l AS (SELECT venue, symbol, kind, ts_us, qty * 100 AS lag_ms FROM ticks) SELECT venue, symbol, kind, count(*) AS n, avg(CASE WHEN lag_ms <= 5000 THEN 1.0 ELSE 0 END) AS fresh_share, max(lag_ms) AS lag_max, max(ts_us) AS last_us,
 CASE WHEN count(*) = 0 THEN 'ABSENT' WHEN avg(CASE WHEN lag_ms <= 5000 THEN 1.0 ELSE 0 END) >= 0.5 THEN 'FRESH' ELSE 'STALE' END AS status FROM l GROUP BY 1, 2, 3""", "fresh_share")
def modality_audit(spark, folder):
    t = ticks(spark, folder).withColumn("lag_ms", F.col("qty") * 100)
    share = F.avg(ind(F.col("lag_ms") <= 5000))
    return t.groupBy("venue", "symbol", "kind").agg(F.count(F.lit(1)).alias("n"), share.alias("fresh_share"), F.max("lag_ms").alias("lag_max"), F.max("ts_us").alias("last_us"),
                                                   F.when(share >= 0.5, "FRESH").otherwise("STALE").alias("status"))


@query("execution_tca", "J40 J41", f"""WITH {TICKS}, p AS (SELECT * FROM ticks WHERE kind = 'purchase'), q AS (SELECT * FROM ticks WHERE kind = 'view'), a AS (SELECT p.event_id, p.symbol, p.ts_us, p.ts_us + {HOUR_US} AS later, p.price, p.qty, CASE WHEN p.qty % 2 = 0 THEN 1 ELSE -1 END AS side, q.price AS mid FROM p ASOF JOIN q ON q.symbol = p.symbol AND p.ts_us >= q.ts_us),
f AS (SELECT a.*, q.price AS fmid, q.ts_us AS ft FROM a ASOF LEFT JOIN q ON q.symbol = a.symbol AND a.later <= q.ts_us)
SELECT event_id, side * (price / mid - 1) * 10000 AS shortfall_bps, least(qty, 60) / qty::DOUBLE AS fill_ratio, 5.0 + side * (price / mid - 1) * 10000 AS all_in_bps, side * (fmid / price - 1) * 10000 AS markout_bps FROM f WHERE qty > 0""", "shortfall_bps fill_ratio all_in_bps markout_bps", digits=4)
def execution_tca(spark, folder):
    t = ticks(spark, folder)
    q = t.where("kind = 'view'").select("symbol", "ts_us", "event_id", "price")
    p = t.where("kind = 'purchase' and qty > 0").select("event_id", "symbol", "ts_us", (F.col("ts_us") + HOUR_US).alias("later"), "price", "qty", F.when(F.col("qty") % 2 == 0, 1).otherwise(-1).alias("side"))
    d = asof_join(p, q, by=["symbol"], left_clock="ts_us", right_clock="ts_us", cols=["price"], prefix="m_", tie=["event_id"]).where("m_price is not null")
    d = asof_join(d, q, by=["symbol"], left_clock="later", right_clock="ts_us", cols=["price"], prefix="f_", tie=["event_id"], direction="forward")
    short = F.col("side") * (F.col("price") / F.col("m_price") - 1) * 1e4
    return d.select("event_id", short.alias("shortfall_bps"), (F.least(F.col("qty"), F.lit(60)) / F.col("qty")).alias("fill_ratio"), (5.0 + short).alias("all_in_bps"),
                    (F.col("side") * (F.col("f_price") / F.col("price") - 1) * 1e4).alias("markout_bps"))


@query("wallet_flow", "F20 J19", f"""WITH {TICKS}, q AS (SELECT symbol, ts_us, price FROM ticks WHERE kind = 'view'), p AS (SELECT *, ts_us + {6 * HOUR_US} AS ripe FROM ticks WHERE kind <> 'view'), m AS (SELECT p.event_id, p.user_id, p.ts_us, p.ripe, CASE WHEN p.is_sell THEN -1 ELSE 1 END * 10000 * (q.price / p.price - 1) AS mo FROM p ASOF LEFT JOIN q ON q.symbol = p.symbol AND p.ripe >= q.ts_us)
SELECT a.event_id, a.mo AS markout_bps, count(b.event_id) AS matured, coalesce(sum(b.mo), 0) / (count(b.event_id) + 20.0) AS score FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND b.mo IS NOT NULL AND b.ripe < a.ts_us GROUP BY a.event_id, a.mo""", "markout_bps score", digits=3)
def wallet_flow(spark, folder):
    t = ticks(spark, folder)
    q = t.where("kind = 'view'").groupBy("symbol", "ts_us").agg(F.max_by("price", "event_id").alias("fair"))
    d = M.wallet_scores(t.where("kind <> 'view'").select("event_id", "symbol", "user_id", "ts_us", "price", "is_sell"), q, by="symbol", wallet="user_id", clock="ts_us", price="price", sell="is_sell",
                        unit="event_id", fair="fair", fair_clock="ts_us", horizon=6 * HOUR_US, prior=20.0)
    return d.select("event_id", "markout_bps", F.col("matured").cast("bigint").alias("matured"), "score")


_BOOKU = f"""{TICKS}, u AS (SELECT event_id, symbol, ts_us, ts_us // {DAY_US} AS slot, is_sell, floor(price / 10) AS level, qty, CASE WHEN event_id % 97 = 0 THEN 'snapshot' WHEN event_id % 9 = 0 THEN 'remove' ELSE 'update' END AS action FROM ticks),
sn AS (SELECT symbol, slot, max(ts_us) AS snap FROM u WHERE action = 'snapshot' GROUP BY 1, 2), g AS (SELECT symbol, unnest(generate_series(min(slot), max(slot))) AS slot FROM u GROUP BY symbol), ls AS (SELECT g.symbol, g.slot, sn.snap FROM g ASOF JOIN sn ON sn.symbol = g.symbol AND g.slot >= sn.slot)"""


@query("order_book_replay", "F21 S5", f"""WITH {_BOOKU}, r AS (SELECT ls.symbol, ls.slot, u.is_sell, u.level, arg_max(u.qty, (u.ts_us, u.event_id)) AS qty, arg_max(u.action, (u.ts_us, u.event_id)) AS action FROM ls JOIN u ON u.symbol = ls.symbol AND u.slot <= ls.slot AND u.ts_us >= ls.snap GROUP BY 1, 2, 3, 4)
SELECT symbol, slot, is_sell, level, qty FROM r WHERE action <> 'remove' AND qty > 0""", "level")
def order_book_replay(spark, folder):
    i = F.col("event_id")
    u = ticks(spark, folder).select("event_id", "symbol", "ts_us", "is_sell", F.floor(F.col("price") / 10).cast("double").alias("level"), "qty",
                                    F.when(i % 97 == 0, "snapshot").when(i % 9 == 0, "remove").otherwise("update").alias("action"))
    return M.book_at_grid(u, keys=["symbol"], side="is_sell", price="level", qty="qty", action="action", clock="ts_us", order=["ts_us", "event_id"], step=DAY_US)


@query("derivative_states", "F22 J18 I26", f"""WITH {TICKS}, g AS (SELECT DISTINCT symbol, ts_us - ts_us % {SIX} AS slot FROM ticks), oi AS (SELECT symbol, ts_us, qty AS oi, qty / nullif(lag(qty) OVER (PARTITION BY symbol ORDER BY ts_us, event_id), 0)::DOUBLE - 1 AS chg FROM ticks WHERE kind = 'signup'), mk AS (SELECT symbol, ts_us, price AS mark FROM ticks WHERE kind = 'view'), ix AS (SELECT symbol, ts_us, price AS idx FROM ticks WHERE kind = 'click'),
a AS (SELECT g.*, oi.oi, oi.chg, oi.ts_us AS t1 FROM g ASOF LEFT JOIN oi ON oi.symbol = g.symbol AND g.slot >= oi.ts_us), b AS (SELECT a.*, mk.mark FROM a ASOF LEFT JOIN mk ON mk.symbol = a.symbol AND a.slot >= mk.ts_us), c AS (SELECT b.*, ix.idx FROM b ASOF LEFT JOIN ix ON ix.symbol = b.symbol AND b.slot >= ix.ts_us)
SELECT symbol, slot, oi, chg AS oi_change, (slot - t1) / 1e6 AS oi_age_sec, (mark / idx - 1) * 10000 AS basis_bps FROM c""", "oi_change oi_age_sec basis_bps", digits=4)
def derivative_states(spark, folder):
    t = ticks(spark, folder)
    g = t.select("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(SIX))).alias("slot")).distinct()
    s = sequence(t.where("kind = 'signup'").select("symbol", "ts_us", "event_id", F.col("qty").alias("oi")), ["symbol"], ["ts_us", "event_id"], back=1)
    oi = s.add({"chg": R.pct_change(s, "oi")}).result()
    side = lambda k, n: t.where(F.col("kind") == k).select("symbol", "ts_us", "event_id", F.col("price").alias(n))
    d = asof_contexts(g, [Context(oi, "ts_us", ["oi", "chg"], "o_", ["event_id"]), Context(side("view", "mark"), "ts_us", ["mark"], "m_", ["event_id"]),
                          Context(side("click", "idx"), "ts_us", ["idx"], "i_", ["event_id"])], by=["symbol"], left_clock="slot")
    return d.select("symbol", "slot", F.col("o_oi").alias("oi"), F.col("o_chg").alias("oi_change"), ((F.col("slot") - F.col("o_ts_us")) / 1e6).alias("oi_age_sec"),
                    ((F.col("m_mark") / F.col("i_idx") - 1) * 1e4).alias("basis_bps"))


_OPT = f"""{TICKS}, o AS (SELECT symbol, ts_us // {DAY_US} AS day, event_id, 20 + qty AS strike, price / 100 AS iv, (qty % 100) / 100.0 - 0.5 AS delta, user_id % 2 AS expiry FROM ticks), s AS (SELECT symbol, day, avg(20 + qty) AS spot FROM (SELECT symbol, ts_us // {DAY_US} AS day, qty FROM ticks) GROUP BY 1, 2)"""


@query("option_surface", "I24", f"""WITH {_OPT} SELECT o.symbol, o.day, arg_min(iv, (abs(strike - spot), event_id)) FILTER (expiry = 0) AS atm_near, arg_min(iv, (abs(delta - 0.25), event_id)) FILTER (expiry = 0) - arg_min(iv, (abs(delta + 0.25), event_id)) FILTER (expiry = 0) AS risk_reversal,
 arg_min(iv, (abs(strike - spot), event_id)) FILTER (expiry = 1) - arg_min(iv, (abs(strike - spot), event_id)) FILTER (expiry = 0) AS term_slope FROM o JOIN s ON s.symbol = o.symbol AND s.day = o.day GROUP BY 1, 2""", "atm_near risk_reversal term_slope")
def option_surface(spark, folder):
    o = ticks(spark, folder).select("symbol", F.floor(F.col("ts_us") / DAY_US).alias("day"), "event_id", (20 + F.col("qty")).alias("strike"), (F.col("price") / 100).alias("iv"),
                                    ((F.col("qty") % 100) / 100.0 - 0.5).alias("delta"), (F.col("user_id") % 2).alias("expiry"))
    s = o.groupBy("symbol", "day").agg(F.avg("strike").alias("spot"))
    near = lambda dist, e: F.min_by("iv", F.when(F.col("expiry") == e, F.struct(dist, "event_id")))
    atm = lambda e: near(F.abs(F.col("strike") - F.col("spot")), e)
    rr = near(F.abs(F.col("delta") - 0.25), 0) - near(F.abs(F.col("delta") + 0.25), 0)
    return o.join(s, ["symbol", "day"]).groupBy("symbol", "day").agg(atm(0).alias("atm_near"), rr.alias("risk_reversal"), (atm(1) - atm(0)).alias("term_slope"))


@query("cascade_pressure", "I25", f"""WITH {TICKS}, b AS (SELECT symbol, qty % 5 AS band, sum(price) FILTER (is_sell) AS liq, sum(price) FILTER (NOT is_sell) AS depth FROM ticks GROUP BY 1, 2) SELECT symbol, max(coalesce(liq, 0) / greatest(coalesce(depth, 0), 1)) AS worst, avg(coalesce(liq, 0) / greatest(coalesce(depth, 0), 1)) AS mean FROM b GROUP BY 1""", "worst mean")
def cascade_pressure(spark, folder):
    t = ticks(spark, folder).withColumn("band", F.col("qty") % 5)
    b = t.groupBy("symbol", "band").agg((F.sum(ind(F.col("is_sell"), F.col("price"))) / F.greatest(F.sum(ind(~F.col("is_sell"), F.col("price"))), F.lit(1.0))).alias("p"))
    return b.groupBy("symbol").agg(F.max("p").alias("worst"), F.avg("p").alias("mean"))


_VT = f"""{BARS}, e AS (SELECT symbol, volume, (high - low) / low AS rg FROM bars), r AS (SELECT symbol, volume, rg, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY symbol ORDER BY rg) + (count(*) OVER (PARTITION BY symbol, rg) - 1) / 2.0 AS rr FROM e),
f AS (SELECT symbol, quantile_cont(volume, 0.1) / median(volume) AS floor_ratio, corr(rv, rr) AS coupling, log10(median(volume)) AS log_volume, avg(CASE WHEN rg = 0 THEN 1.0 ELSE 0 END) AS zero_range FROM r GROUP BY 1)"""


def volume_trust_table(spark, folder):
    e = bars(spark, folder).select("symbol", "volume", ((F.col("high") - F.col("low")) / F.col("low")).alias("rg"))
    q = exact_quantiles(e, ["symbol"], "volume", {"p10": 0.1, "p50": 0.5})
    e = e.withColumns({"rv": average_rank("volume", "symbol"), "rr": average_rank("rg", "symbol")})
    d = e.groupBy("symbol").agg(F.corr("rv", "rr").alias("coupling"), F.avg(ind(F.col("rg") == 0)).alias("zero_range")).join(q, "symbol")
    return d.select("symbol", (F.col("p10") / F.col("p50")).alias("floor_ratio"), "coupling", F.log10("p50").alias("log_volume"), "zero_range")


@query("volume_trust", "I32", f"WITH {_VT} SELECT * FROM f", "floor_ratio coupling log_volume zero_range")
def volume_trust(spark, folder):
    return volume_trust_table(spark, folder)


@query("volume_anomaly_rank", "I34", f"""WITH {_VT}, k AS (SELECT symbol, (rank() OVER (ORDER BY round(floor_ratio, 9)) + (count(*) OVER (PARTITION BY round(floor_ratio, 9)) - 1) / 2.0 - 0.5) / count(*) OVER () AS a, (rank() OVER (ORDER BY round(zero_range, 9)) + (count(*) OVER (PARTITION BY round(zero_range, 9)) - 1) / 2.0 - 0.5) / count(*) OVER () AS b FROM f) SELECT symbol, (a + b) / 2 AS mean_rank, (a + b) / 2 >= 0.7 AS flagged FROM k""", "mean_rank")
def volume_anomaly_rank(spark, folder):
    d = volume_trust_table(spark, folder).withColumns({"g": F.lit(0), "a": F.round("floor_ratio", 9), "b": F.round("zero_range", 9)})  # one row per event
    n = F.count(F.lit(1)).over(Window.partitionBy("g"))
    share = lambda x: (average_rank(x, "g") - 0.5) / n
    mean = (share("a") + share("b")) / 2
    return d.select("symbol", mean.alias("mean_rank"), (mean >= 0.7).alias("flagged"))


@query("venue_control", "I35 I36", f"""WITH {TICKS}, h AS (SELECT symbol, venue, ts_us // {DAY_US} AS hour, sum(qty) AS v FROM ticks GROUP BY 1, 2, 3), j AS (SELECT a.symbol, a.v AS va, b.v AS vb FROM h a JOIN h b ON a.symbol = b.symbol AND a.hour = b.hour AND a.venue = 0 AND b.venue = 1 WHERE b.v > 0)
SELECT symbol, count(*) AS common, median(va / vb) AS multiple, avg(va) - avg(vb) AS difference, sqrt(var_samp(va) / count(*) + var_samp(vb) / count(*)) AS se FROM j GROUP BY 1""", "multiple difference se")
def venue_control(spark, folder):
    h = ticks(spark, folder).groupBy("symbol", "venue", F.floor(F.col("ts_us") / DAY_US).alias("hour")).agg(F.sum("qty").alias("v"))
    side = lambda k, n: h.where(F.col("venue") == k).select("symbol", "hour", F.col("v").alias(n))
    j = side(0, "va").join(side(1, "vb"), ["symbol", "hour"]).where("vb > 0")
    n = F.count(F.lit(1))
    return j.groupBy("symbol").agg(n.alias("common"), F.percentile(F.col("va") / F.col("vb"), F.lit(0.5)).alias("multiple"), (F.avg("va") - F.avg("vb")).alias("difference"),
                                   F.sqrt(F.var_samp("va") / n + F.var_samp("vb") / n).alias("se"))


@query("pre_event_features", "I37 I38 I39", f"""WITH {BARS}, e AS (SELECT event_id, symbol, ts_us FROM ticks WHERE kind = 'error'), j AS (SELECT e.event_id, e.ts_us, b.bar, b.close, b.high, b.low, b.volume FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar + {HOUR_US} <= e.ts_us AND b.bar >= e.ts_us - {3 * DAY_US})
SELECT event_id, count(*) AS n, CASE WHEN count(*) >= 6 THEN arg_max(close, bar) / arg_min(close, bar) - 1 END AS ret, max(high) / min(low) - 1 AS range_ratio, avg(volume) FILTER (bar >= ts_us - {DAY_US}) / nullif(median(volume), 0) AS anticipation FROM j GROUP BY 1""", "ret range_ratio anticipation")
def pre_event_features(spark, folder):
    from tidemark.operators.asof import interval_pairs
    b = bars(spark, folder).select("symbol", "bar", "close", "high", "low", "volume")
    e = ticks(spark, folder).where("kind = 'error'").select("event_id", "symbol", "ts_us", (F.col("ts_us") - 3 * DAY_US).alias("lo"), (F.col("ts_us") - HOUR_US).alias("hi"))
    j = interval_pairs(e, b, by=["symbol"], lo="lo", hi="hi", right_clock="bar", width=3 * DAY_US)
    recent = F.avg(F.when(F.col("bar") >= F.col("ts_us") - DAY_US, F.col("volume")))
    return j.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 6, F.max_by("close", "bar") / F.min_by("close", "bar") - 1).alias("ret"),
                                     (F.max("high") / F.min("low") - 1).alias("range_ratio"), div(recent, F.percentile("volume", F.lit(0.5))).alias("anticipation"))


@query("archetype_scores", "I40", f"""WITH {PANEL}, s AS (SELECT day, symbol, [1 / (1 + exp(-(fund * 50))), 1 / (1 + exp(-((ratio - 0.54) * 40))), 1 / (1 + exp(-((close / open - 1) * 2)))] AS v FROM panel) SELECT day, symbol, list_max(v) AS best, list_position(v, list_max(v)) AS context FROM s""", "best")
def archetype_scores(spark, folder):
    sig = lambda x: 1 / (1 + F.exp(-x))
    v = F.array(sig(F.col("fund") * 50), sig((F.col("ratio") - 0.54) * 40), sig((F.col("close") / F.col("open") - 1) * 2))
    d = panel(spark, folder).select("day", "symbol", v.alias("v"))
    return d.select("day", "symbol", F.array_max("v").alias("best"), F.array_position("v", F.array_max("v")).alias("context"))


# --- accounting tables -------------------------------------------------------------------------


@query("intent_netting", "O16", """WITH i AS (SELECT l_partkey % 40 AS asset, l_suppkey % 10 AS alpha, max((l_discount - 0.05) * 10) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), n AS (SELECT asset, sum(f) AS net, count(*) AS n_intents FROM i GROUP BY 1), c AS (SELECT *, least(greatest(net, -4), 4) AS capped FROM n)
SELECT asset, net, n_intents, capped, capped * least(1, 100 / sum(abs(capped)) OVER ()) AS final FROM c""", "net capped final")
def intent_netting(spark, folder):
    l = read(spark, folder, "lineitem").where("l_returnflag = 'R'")
    i = l.groupBy((F.col("l_partkey") % 40).alias("asset"), (F.col("l_suppkey") % 10).alias("alpha")).agg(F.max((F.col("l_discount") - 0.05) * 10).alias("f"))
    return P.net_positions(i, asset="asset", fraction="f", cap=4.0, gross_cap=100.0)


@query("ledger_nav", "O17 O18 O24", """WITH l AS (SELECT o_orderstatus AS kind, o_orderpriority AS sleeve, CAST(o_totalprice AS DECIMAL(18, 2)) AS amount FROM orders) SELECT kind, sleeve, CAST(sum(CASE WHEN kind = 'F' THEN -amount ELSE amount END) AS DOUBLE) AS amount, CAST(grouping(kind, sleeve) AS BIGINT) AS level FROM l GROUP BY GROUPING SETS ((), (kind), (sleeve))""", "amount", digits=2)
def ledger_nav(spark, folder):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    l = read(spark, folder, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("sleeve"), F.when(F.col("o_orderstatus") == "F", -amount).otherwise(amount).alias("amount"))
    return l.groupingSets([[], ["kind"], ["sleeve"]], "kind", "sleeve").agg(F.sum("amount").cast("double").alias("amount"), F.grouping_id().cast("bigint").alias("level"))


@query("ledger_integrity", "O19", "SELECT o_orderdate::DATE::VARCHAR AS day, o_orderstatus AS kind, o_orderpriority AS sleeve, count(*) AS n FROM orders GROUP BY 1, 2, 3 HAVING count(*) > 1")
def ledger_integrity(spark, folder):
    o = read(spark, folder, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("sleeve")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_CHAIN = """b AS (SELECT o_orderkey AS seq, o_orderkey || ':' || o_custkey AS body, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders), c AS (SELECT seq, i, body, sha256(coalesce(lag(body) OVER (ORDER BY i), '') || body) AS chain FROM b), t AS (SELECT seq, i, body, CASE WHEN seq % 5000 = 7 THEN 'tampered' ELSE chain END AS chain FROM c)"""


@query("ledger_chain_breaks", "O20", f"WITH {_CHAIN}, v AS (SELECT *, sha256(coalesce(lag(chain) OVER (ORDER BY i), '') || body) AS expected FROM t) SELECT seq, chain = 'tampered' AS tampered FROM v WHERE chain <> expected")
def ledger_chain_breaks(spark, folder):
    # A stored chain with some rows altered, checked in parallel from each row and its predecessor.
    o = read(spark, folder, "orders").select(F.lit(0).alias("book"), F.col("o_orderkey").alias("seq"), F.concat_ws(":", "o_orderkey", "o_custkey").alias("body"))
    s = sequence(o, ["book"], ["seq"], back=1)
    o = s.add({"chain": F.sha2(F.concat(F.coalesce(F.lag("body").over(s.by()), F.lit("")), "body"), 256)}).result()
    o = o.withColumn("chain", F.when(F.col("seq") % 5000 == 7, "tampered").otherwise(F.col("chain")))
    d = P.ledger_chain_breaks(o, order=["seq"], body="body", chain="chain", keys=["book"])
    return d.select("seq", (F.col("chain") == "tampered").alias("tampered"))


@query("position_reconcile", "O22 O23 O25", """WITH f AS (SELECT l_partkey % 100 AS product, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT l_partkey % 100 AS product, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) + CASE WHEN l_partkey % 100 % 13 = 0 THEN 5 ELSE 0 END AS qty, count(*) AS n FROM lineitem WHERE l_partkey % 100 <> 99 GROUP BY l_partkey % 100)
SELECT product, 'qty' AS field, f.qty AS ours, p.qty AS theirs FROM f FULL JOIN p USING (product) WHERE p.qty IS NULL OR abs(f.qty - p.qty) > 0.5 UNION ALL SELECT product, 'n', f.n, p.n FROM f FULL JOIN p USING (product) WHERE p.n IS NULL OR abs(f.n - p.n) > 0""", "ours theirs")
def position_reconcile(spark, folder):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("decimal(18,2)")
    f = read(spark, folder, "lineitem").groupBy((F.col("l_partkey") % 100).alias("product")).agg(F.sum(signed).alias("qty"), F.count(F.lit(1)).alias("n"))
    p = f.where("product <> 99").withColumn("qty", F.col("qty") + F.when(F.col("product") % 13 == 0, 5).otherwise(0))
    return P.reconcile(f, p, ["product"], {"qty": 0.5, "n": 0.0})


@query("exposures", "O25", f"""WITH {DECISIONS}, m AS (SELECT symbol, max_by(gross_bps, id) AS mark FROM decisions GROUP BY 1) SELECT tier, sum(CASE WHEN side > 0 THEN abs(mark) ELSE 0 END) AS long_usd, sum(CASE WHEN side < 0 THEN abs(mark) ELSE 0 END) AS short_usd, sum(abs(mark)) AS gross_usd, sum(side * abs(mark)) AS net_usd FROM decisions d JOIN m ON m.symbol = d.symbol GROUP BY 1""", "long_usd short_usd gross_usd net_usd", digits=3)
def exposures(spark, folder):
    d = decisions(spark, folder)
    m = d.groupBy("symbol").agg(F.abs(F.max_by("gross_bps", "id")).alias("mark"))
    d = d.join(m, "symbol")
    return d.groupBy("tier").agg(F.sum(ind(F.col("side") > 0, F.col("mark"))).alias("long_usd"), F.sum(ind(F.col("side") < 0, F.col("mark"))).alias("short_usd"), F.sum("mark").alias("gross_usd"), F.sum(F.col("side") * F.col("mark")).alias("net_usd"))


@query("trade_summary", "O14", f"""WITH {DECISIONS} SELECT tier, count(*) AS n, avg(gross_bps) AS mean, median(gross_bps) AS mid, sum(CASE WHEN gross_bps > 0 THEN gross_bps ELSE 0 END) / -sum(CASE WHEN gross_bps < 0 THEN gross_bps ELSE 0 END) AS pf FROM decisions GROUP BY 1""", "mean mid pf")
def trade_summary(spark, folder):
    d = decisions(spark, folder)
    x = F.col("gross_bps")
    q = exact_quantiles(d, ["tier"], "gross_bps", {"mid": 0.5})
    return d.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), (F.sum(ind(x > 0, x)) / -F.sum(ind(x < 0, x))).alias("pf")).join(q, "tier")
