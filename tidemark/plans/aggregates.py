"""Resampling and grouped aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import div, ind
from tidemark.operators import resample as D
from tidemark.operators import rolling as R
from tidemark.operators.asof import asof_join
from tidemark.operators.blocks import DAYS, HOURS, running_total, sequence
from tidemark.operators.crosssection import exact_quantiles
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, TICKS, bars, bars_sql, decisions, panel, read, ticks

_OHLC = "open high low close volume quote_volume trades taker_buy_base taker_buy_quote"


@query("ohlcv_hourly", "D1 D3 D16", f"WITH {BARS} SELECT * FROM bars", _OHLC)
def ohlcv_hourly(spark, folder):
    return bars(spark, folder)


@query("ohlcv_five_minutes", "D2", f"WITH {TICKS}, {bars_sql(300_000_000)} SELECT * FROM bars", _OHLC)
def ohlcv_five_minutes(spark, folder):
    return bars(spark, folder, 300_000_000)


@query("ohlcv_coarser", "D4", f"""WITH {BARS} SELECT symbol, bar - bar % {4 * HOUR_US} AS bar, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, bar) AS close, sum(volume) AS volume, sum(quote_volume) AS quote_volume, sum(trades) AS trades, sum(taker_buy_base) AS taker_buy_base
 FROM bars GROUP BY 1, 2""", "open high low close volume quote_volume trades taker_buy_base")
def ohlcv_coarser(spark, folder):
    d = D.coarser(bars(spark, folder), keys=["symbol"], width=4 * HOUR_US, sums=["volume", "quote_volume", "trades", "taker_buy_base"])
    return d.select("symbol", "bar", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base")


@query("completed_context", "D5 H32", f"""WITH {BARS}, h AS (SELECT symbol, bar - bar % {4 * HOUR_US} AS hbar, arg_max(close, bar) AS hc, max(high) AS hh, min(low) AS hl FROM bars GROUP BY 1, 2),
f AS (SELECT symbol, hbar + {4 * HOUR_US} AS done, hc / lag(hc) OVER w - 1 AS ret4h, (hc - min(hl) OVER (PARTITION BY symbol ORDER BY hbar ROWS 5 PRECEDING)) AS over_low FROM h WINDOW w AS (PARTITION BY symbol ORDER BY hbar))
SELECT b.symbol, b.bar, f.ret4h, f.over_low FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.bar >= f.done""", "ret4h over_low")
def completed_context(spark, folder):
    b = bars(spark, folder)
    s = sequence(D.coarser(b, keys=["symbol"], width=4 * HOUR_US), ["symbol"], ["bar"], back=6, bound=HOURS)
    s = s.add({"ret4h": R.pct_change(s, "close"), "over_low": F.col("close") - R.low(s, "low", 6, 1), "done": F.col("bar") + 4 * HOUR_US})
    d = asof_join(b.select("symbol", "bar"), s.result(), by=["symbol"], left_clock="bar", right_clock="done", cols=["ret4h", "over_low"], prefix="c_")
    return d.select("symbol", "bar", F.col("c_ret4h").alias("ret4h"), F.col("c_over_low").alias("over_low"))


@query("aggressor_flow_bars", "D7 H37", f"""WITH {TICKS}, t AS (SELECT *, price * qty AS usd, ts_us - ts_us % {6 * HOUR_US} AS bar FROM ticks)
SELECT symbol, bar, sum(CASE WHEN NOT is_sell THEN usd ELSE 0 END) AS buy_usd, sum(CASE WHEN is_sell THEN usd ELSE 0 END) AS sell_usd,
 sum(CASE WHEN NOT is_sell THEN CAST(qty AS DOUBLE) ELSE 0 END) AS buy_qty, sum(CASE WHEN is_sell THEN CAST(qty AS DOUBLE) ELSE 0 END) AS sell_qty, count(*) AS n_trades, avg(usd) AS avg_usd,
 quantile_cont(usd, 0.95) AS p95_usd, sum(CASE WHEN NOT is_sell AND usd >= 2000 THEN usd ELSE 0 END) AS large_buy_usd,
 sum(CASE WHEN is_sell AND usd >= 2000 THEN usd ELSE 0 END) AS large_sell_usd,
 sum(CASE WHEN NOT is_sell THEN usd ELSE 0 END) / nullif(sum(CASE WHEN NOT is_sell THEN qty ELSE 0 END), 0) AS buy_vwap,
 sum(CASE WHEN is_sell THEN usd ELSE 0 END) / nullif(sum(CASE WHEN is_sell THEN qty ELSE 0 END), 0) AS sell_vwap,
 sum(CASE WHEN NOT is_sell THEN usd ELSE 0 END) - sum(CASE WHEN is_sell THEN usd ELSE 0 END) AS signed_volume FROM t GROUP BY 1, 2""",
       "buy_usd sell_usd buy_qty sell_qty avg_usd p95_usd large_buy_usd large_sell_usd buy_vwap sell_vwap signed_volume", digits=4)
def aggressor_flow_bars(spark, folder):
    return D.flow_bars(ticks(spark, folder), keys=["symbol"], clock="ts_us", price="price", qty="qty", is_sell="is_sell", width=6 * HOUR_US, large=2000.0)


@query("cumulative_volume_delta", "D8", f"""WITH {TICKS} SELECT event_id, symbol, CAST(sum(CASE WHEN is_sell THEN -qty ELSE qty END) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS BIGINT) AS cvd FROM ticks""")
def cumulative_volume_delta(spark, folder):
    t = ticks(spark, folder).select("event_id", "symbol", "ts_us", F.when(F.col("is_sell"), -F.col("qty")).otherwise(F.col("qty")).alias("signed"))
    return running_total(t, ["symbol"], ["ts_us", "event_id"], {"cvd": F.col("signed")}, 7 * DAY_US).select("event_id", "symbol", "cvd")


@query("daily_funding_and_mark", "D9 A21", f"""WITH {TICKS} SELECT symbol, ts_us // {DAY_US} AS day, avg(CASE WHEN kind = 'error' THEN price END) AS funding,
 max_by(price, (ts_us, event_id)) AS mark, count(*) AS n FROM ticks GROUP BY 1, 2""", "funding mark")
def daily_funding_and_mark(spark, folder):
    t = ticks(spark, folder)
    return t.groupBy("symbol", F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(
        F.avg(F.when(F.col("kind") == "error", F.col("price"))).alias("funding"),
        F.max_by("price", F.struct("ts_us", "event_id")).alias("mark"), F.count(F.lit(1)).alias("n"))


@query("options_daily_positioning", "D10", f"""WITH {TICKS}, o AS (SELECT ts_us // {DAY_US} AS day, qty AS strike, 0.8 + (price % 40) / 100 AS mny, price / 100 AS iv, is_sell AS put, price * qty AS prem,
 CASE WHEN kind IN ('purchase', 'error') THEN 1 ELSE -1 END AS dir, qty >= 80 AS is_block FROM ticks),
k AS (SELECT day, strike, sum(prem) AS p FROM o GROUP BY 1, 2), ks AS (SELECT day, max(p) / sum(p) AS top_share FROM k GROUP BY 1),
d AS (SELECT day, median(CASE WHEN mny BETWEEN 0.95 AND 1.05 THEN iv END) AS atm_iv,
 median(CASE WHEN put AND mny < 0.95 THEN iv END) - median(CASE WHEN NOT put AND mny > 1.05 THEN iv END) AS skew,
 sum(CASE WHEN put THEN prem END) / nullif(sum(CASE WHEN NOT put THEN prem END), 0) AS put_call, sum(dir * prem) / sum(prem) AS net_flow,
 sum(CASE WHEN is_block THEN prem ELSE 0 END) / sum(prem) AS block_share FROM o GROUP BY 1)
SELECT d.*, ks.top_share, atm_iv - lag(atm_iv) OVER w AS atm_iv_chg, skew - lag(skew) OVER w AS skew_chg FROM d JOIN ks USING (day) WINDOW w AS (ORDER BY d.day)""",
       "atm_iv skew put_call net_flow block_share top_share atm_iv_chg skew_chg")
def options_daily_positioning(spark, folder):
    o = ticks(spark, folder).select(
        F.floor(F.col("ts_us") / DAY_US).alias("day"), F.col("qty").alias("strike"), (0.8 + (F.col("price") % 40) / 100).alias("mny"),
        (F.col("price") / 100).alias("iv"), F.col("is_sell").alias("put"), (F.col("price") * F.col("qty")).alias("prem"),
        F.when(F.col("kind").isin("purchase", "error"), 1).otherwise(-1).alias("dir"), (F.col("qty") >= 80).alias("is_block"))
    mny, put, prem = F.col("mny"), F.col("put"), F.col("prem")
    wing = F.when(mny.between(0.95, 1.05), "atm").when(put & (mny < 0.95), "put").when(~put & (mny > 1.05), "call")
    iv = exact_quantiles(o.withColumn("wing", wing).where("wing is not null"), ["day", "wing"], "iv", {"mid": 0.5})
    pick = lambda k: F.max(F.when(F.col("wing") == k, F.col("mid")))
    iv = iv.groupBy("day").agg(pick("atm").alias("atm_iv"), (pick("put") - pick("call")).alias("skew"))
    d = o.groupBy("day").agg(
        div(F.sum(F.when(put, prem)), F.sum(F.when(~put, prem))).alias("put_call"), div(F.sum(F.col("dir") * prem), F.sum(prem)).alias("net_flow"),
        div(F.sum(ind(F.col("is_block"), prem)), F.sum(prem)).alias("block_share")).join(iv, "day", "left")
    top = o.groupBy("day", "strike").agg(F.sum("prem").alias("p")).groupBy("day").agg((F.max("p") / F.sum("p")).alias("top_share"))
    s = sequence(d.join(top, "day").withColumn("market", F.lit("all")), ["market"], ["day"], back=1, bound=DAYS)
    return s.add({"atm_iv_chg": R.change(s, "atm_iv"), "skew_chg": R.change(s, "skew")}).result().drop("market")


@query("options_daily_flow", "D11", f"""WITH {TICKS} SELECT ts_us // {DAY_US} AS day, sum(CASE WHEN is_sell AND price < 20 THEN price * qty ELSE 0 END) / sum(price * qty) AS far_put_share,
 count(*) FILTER (qty >= 80) AS n_blocks, count(*) AS n_trades FROM ticks GROUP BY 1""", "far_put_share")
def options_daily_flow(spark, folder):
    usd = F.col("price") * F.col("qty")
    return ticks(spark, folder).groupBy(F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(
        (F.sum(ind(F.col("is_sell") & (F.col("price") < 20), usd)) / F.sum(usd)).alias("far_put_share"),
        F.count(F.when(F.col("qty") >= 80, 1)).alias("n_blocks"), F.count(F.lit(1)).alias("n_trades"))


@query("daily_realised_volatility", "D12", f"""WITH {BARS}, r AS (SELECT symbol, bar // {DAY_US} AS day, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar)) AS r FROM bars)
SELECT symbol, day, sqrt(sum(r * r)) AS rv, stddev_samp(r) AS sd, count(r) AS n FROM r GROUP BY 1, 2""", "rv sd")
def daily_realised_volatility(spark, folder):
    s = sequence(bars(spark, folder), ["symbol"], ["bar"], back=1, bound=HOURS)
    d = s.add({"r": F.ln(F.col("close") / R.lag(s, "close"))}).result()
    return d.groupBy("symbol", F.floor(F.col("bar") / DAY_US).alias("day")).agg(
        F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("rv"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n"))


@query("liquidation_flow", "D13 S11", f"""WITH {TICKS}, e AS (SELECT symbol, ts_us - ts_us % {HOUR_US} AS bar, price * qty AS usd, is_sell FROM ticks WHERE kind IN ('error', 'click'))
SELECT symbol, bar, sum(CASE WHEN is_sell THEN usd ELSE 0 END) AS long_usd, sum(CASE WHEN NOT is_sell THEN usd ELSE 0 END) AS short_usd,
 coalesce((sum(CASE WHEN NOT is_sell THEN usd ELSE 0 END) - sum(CASE WHEN is_sell THEN usd ELSE 0 END)) / nullif(sum(usd), 0), 0) AS imbalance FROM e GROUP BY 1, 2""", "long_usd short_usd imbalance")
def liquidation_flow(spark, folder):
    usd, sell = F.col("price") * F.col("qty"), F.col("is_sell")
    e = ticks(spark, folder).where(F.col("kind").isin("error", "click"))
    d = e.groupBy("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(HOUR_US))).alias("bar")).agg(
        F.sum(ind(sell, usd)).alias("long_usd"), F.sum(ind(~sell, usd)).alias("short_usd"))
    return d.withColumn("imbalance", F.coalesce(div(F.col("short_usd") - F.col("long_usd"), F.col("short_usd") + F.col("long_usd")), F.lit(0.0)))


@query("news_pivot", "D14", f"""WITH s AS (SELECT ts, unnest(string_split(CASE user_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH,BTC' WHEN 2 THEN 'SOL' ELSE 'SOL,ETH' END, ',')) AS sym, value FROM events WHERE value > 0)
SELECT epoch_us(ts) // {DAY_US} AS day, avg(value) FILTER (sym = 'BTC') AS btc_mean, count(*) FILTER (sym = 'BTC') AS btc_n, avg(value) FILTER (sym = 'ETH') AS eth_mean,
 count(*) FILTER (sym = 'ETH') AS eth_n, avg(value) FILTER (sym = 'SOL') AS sol_mean, count(*) FILTER (sym = 'SOL') AS sol_n FROM s GROUP BY 1""", "btc_mean eth_mean sol_mean")
def news_pivot(spark, folder):
    tags = F.element_at(F.array(F.lit("BTC"), F.lit("ETH,BTC"), F.lit("SOL"), F.lit("SOL,ETH")), (F.col("user_id") % 4 + 1).cast("int"))
    t = ticks(spark, folder).select(F.floor(F.col("ts_us") / DAY_US).alias("day"), F.explode(F.split(tags, ",")).alias("sym"), "price")
    d = t.groupBy("day").pivot("sym", ["BTC", "ETH", "SOL"]).agg(F.avg("price").alias("mean"), F.count("price").alias("n"))
    return d.select("day", *[F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) if x.endswith("_n") else F.col(x).alias(x.lower()) for x in d.columns if x != "day"])


@query("world_event_features", "D15", f"""WITH {TICKS} SELECT ts_us // {DAY_US} AS day, avg(price) FILTER (kind = 'click') AS click_mean, avg(price) FILTER (kind = 'view') AS view_mean,
 ln(sum(power(10.0, 1.5 * qty / 20.0)) FILTER (kind = 'error')) AS log_energy FROM ticks GROUP BY 1""", "click_mean view_mean log_energy")
def world_event_features(spark, folder):
    t = ticks(spark, folder)
    when = lambda k, x: F.when(F.col("kind") == k, x)
    return t.groupBy(F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(
        F.avg(when("click", F.col("price"))).alias("click_mean"), F.avg(when("view", F.col("price"))).alias("view_mean"),
        F.ln(F.sum(when("error", F.pow(F.lit(10.0), 1.5 * F.col("qty") / 20.0)))).alias("log_energy"))


@query("event_inventory_rollup", "D17", f"""WITH {TICKS} SELECT symbol, is_sell, ts_us // {DAY_US} AS day, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty,
 CAST(grouping(symbol, is_sell, ts_us // {DAY_US}) AS BIGINT) AS level FROM ticks WHERE kind = 'error' GROUP BY ROLLUP (symbol, is_sell, ts_us // {DAY_US})""")
def event_inventory_rollup(spark, folder):
    t = ticks(spark, folder).where("kind = 'error'").withColumn("day", F.floor(F.col("ts_us") / DAY_US))
    return t.rollup("symbol", "is_sell", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.grouping_id().alias("level"))


@query("depth_band_maps", "D18 J27", f"""WITH {TICKS}, b AS (SELECT symbol, ts_us // {HOUR_US} AS slot, is_sell, (qty % 5) * 100 AS band, sum(price) AS notional FROM ticks GROUP BY ALL)
SELECT symbol, slot, sum(CASE WHEN is_sell AND band <= 200 THEN notional ELSE 0 END) AS ask_200, sum(CASE WHEN NOT is_sell AND band <= 200 THEN notional ELSE 0 END) AS bid_200,
 count(*) AS n_bands FROM b GROUP BY 1, 2""", "ask_200 bid_200")
def depth_band_maps(spark, folder):
    t = ticks(spark, folder).withColumns({"slot": F.floor(F.col("ts_us") / HOUR_US), "band": (F.col("qty") % 5) * 100})
    d = t.groupBy("symbol", "slot", "is_sell", "band").agg(F.sum("price").alias("notional"))
    side = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("is_sell") == s, F.struct("band", "notional"))))
    d = d.groupBy("symbol", "slot").agg(side(True).alias("asks"), side(False).alias("bids"), F.count(F.lit(1)).alias("n_bands"))
    inside = lambda m: F.aggregate(F.map_values(F.map_filter(m, lambda k, v: k <= 200)), F.lit(0.0), lambda a, v: a + v)
    return d.select("symbol", "slot", inside("asks").alias("ask_200"), inside("bids").alias("bid_200"), "n_bands")


@query("near_contract", "D19", """WITH d AS (SELECT o_custkey % 50 AS underlying, o_orderdate AS at_day, (o_orderkey % 120) - 20 AS dte, o_totalprice AS price, o_orderkey AS id FROM orders)
SELECT underlying, epoch_us(at_day) AS at_us, arg_min(price, (dte, id)) AS price, min(dte) AS dte FROM d WHERE dte > 0 GROUP BY 1, 2""", "price")
def near_contract(spark, folder):
    d = decisions(spark, folder).select((F.substring("symbol", 2, 2).cast("bigint")).alias("underlying"), F.col("ts_us").alias("at_us"),
                                        (F.col("id") % 120 - 20).alias("dte"), "id", (F.col("gross_bps") * 1000 + 250_000).alias("price"))
    return d.where("dte > 0").groupBy("underlying", "at_us").agg(F.min_by("price", F.struct("dte", "id")).alias("price"), F.min("dte").alias("dte"))


@query("gap_histogram", "D20", f"""WITH {TICKS}, g AS (SELECT (ts_us - lag(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us, event_id)) // {HOUR_US} AS gap FROM ticks)
SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def gap_histogram(spark, folder):
    s = sequence(ticks(spark, folder).select("symbol", "ts_us", "event_id"), ["symbol"], ["ts_us", "event_id"], back=1)
    return D.gap_histogram(s, "ts_us", HOUR_US)


@query("coverage_by_year", "D21", f"WITH {DECISIONS} SELECT year, count(*) AS n FROM decisions GROUP BY 1")
def coverage_by_year(spark, folder):
    return decisions(spark, folder).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("breakdown_by_key", "D22", f"""WITH {DECISIONS} SELECT year, symbol, count(*) AS n, avg(gross_bps - 4) AS mean_net, sum(gross_bps - 4) AS sum_net, avg(gross_bps) AS mean_gross
 FROM decisions GROUP BY GROUPING SETS ((year), (symbol))""", "mean_net sum_net mean_gross", digits=4)
def breakdown_by_key(spark, folder):
    d = decisions(spark, folder).withColumn("net", F.col("gross_bps") - 4)
    return d.groupingSets([["year"], ["symbol"]], "year", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean_net"), F.sum("net").alias("sum_net"), F.avg("gross_bps").alias("mean_gross"))


_FAMILY = f"""WITH {DECISIONS}, u AS (SELECT year, tier, 'h1' AS horizon, gross_bps * side AS r FROM decisions UNION ALL SELECT year, tier, 'h4', gross_bps * side * 0.5 + 1 FROM decisions),
g AS (SELECT horizon, year, tier, count(*) AS n, avg(r) AS mean, avg(r - 4) AS net, avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)) AS t FROM u GROUP BY GROUPING SETS ((horizon), (horizon, year), (horizon, tier)))"""


@query("family_report", "D23 K36", _FAMILY + """ SELECT horizon, year, tier, n, mean, net, t, CASE WHEN net <= 0 THEN 'KILL' WHEN abs(t) < 2 THEN 'WEAK' ELSE 'CANDIDATE' END AS class FROM g""", "mean net t")
def family_report(spark, folder):
    d = decisions(spark, folder).withColumn("r", F.col("gross_bps") * F.col("side"))
    u = d.select("year", "tier", F.col("r").alias("h1"), (F.col("r") * 0.5 + 1).alias("h4")).unpivot(["year", "tier"], ["h1", "h4"], "horizon", "r")
    g = u.groupingSets([["horizon"], ["horizon", "year"], ["horizon", "tier"]], "horizon", "year", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.avg(F.col("r") - 4).alias("net"),
        (div(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.count(F.lit(1)))).alias("t"))
    return g.withColumn("class", F.when(F.col("net") <= 0, "KILL").when(F.abs("t") < 2, "WEAK").otherwise("CANDIDATE"))


@query("record_summary", "D24 N21 N22", f"""WITH {DECISIONS}, d AS (SELECT symbol, ts_us // {DAY_US} AS day, avg(gross_bps) AS p FROM decisions GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER (PARTITION BY symbol ORDER BY day) AS cum FROM d), k AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol ORDER BY day), 0) AS peak FROM c)
SELECT symbol, count(*) AS n, avg(p) AS mean, sum(CASE WHEN p > 0 THEN p ELSE 0 END) / -sum(CASE WHEN p < 0 THEN p ELSE 0 END) AS profit_factor,
 avg(p) / stddev_samp(p) AS sharpe, max(peak - cum) AS max_drawdown FROM k GROUP BY 1""", "mean profit_factor sharpe max_drawdown", digits=4)
def record_summary(spark, folder):
    d = decisions(spark, folder).groupBy("symbol", F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(F.avg("gross_bps").alias("p"))
    return D.drawdown_summary(d, by=["symbol"], order="day", pnl="p")


@query("calendar_panel", "A21 A22", f"""WITH {PANEL}, g AS (SELECT symbol, unnest(generate_series((SELECT min(day) FROM panel), (SELECT max(day) FROM panel))) AS day FROM (SELECT DISTINCT symbol FROM panel))
SELECT g.symbol, g.day, p.close, p.fund, p.oi, p.close / p.spot - 1 AS basis FROM g LEFT JOIN panel p ON p.symbol = g.symbol AND p.day = g.day""", "close fund oi basis")
def calendar_panel(spark, folder):
    d = D.on_calendar(panel(spark, folder), keys=["symbol"], clock="day", step=1)
    return d.select("symbol", "day", "close", "fund", "oi", (F.col("close") / F.col("spot") - 1).alias("basis"))
