"""What the books around a launch support: depth in native bands, slippage of orders, capacity status and its matrix."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import div
from tidemark.operators import micro as M
from tidemark.operators.blocks import RN, number_rows
from tidemark.operators.crosssection import exact_quantiles
from tidemark.plans.market import SIX
from tidemark.plans.registry import query
from tidemark.plans.tables import DAY_US, TICKS, ticks

_BANDS = (20, 100, 200, 300, 400, 500)
_SIDE = lambda keep: f"list({{'bps': bps, 'cum': cum}} ORDER BY bps) FILTER ({keep})"
_BOOK = f"""{TICKS}, t AS (SELECT *, ts_us // {SIX} AS slot, 100 + price * 0.02 AS px FROM ticks), b AS (SELECT symbol, slot, is_sell, {list(_BANDS)}[qty % 6 + 1] AS bps, sum(price * qty) AS n FROM t WHERE qty % 7 > 0 AND (slot % 4 > 0 OR qty % 6 > 0) GROUP BY ALL),
cm AS (SELECT *, sum(n) OVER (PARTITION BY symbol, slot, is_sell ORDER BY bps) AS cum FROM b), bk AS (SELECT symbol, slot, {_SIDE('NOT is_sell')} AS bids, {_SIDE('is_sell')} AS asks FROM cm GROUP BY 1, 2),
tr AS (SELECT symbol, slot, median(px) AS mid, greatest((avg(px) FILTER (NOT is_sell) - avg(px) FILTER (is_sell)) / median(px) * 10000, 0) + CASE WHEN count(*) FILTER (is_sell) * count(*) FILTER (NOT is_sell) = 0 THEN NULL ELSE 0 END AS spread FROM t GROUP BY 1, 2),
j AS (SELECT tr.symbol, tr.slot, mid, spread, bids, asks, bids IS NOT NULL AND asks IS NOT NULL AS ok, CASE WHEN (bids IS NULL) <> (asks IS NULL) THEN 'one side empty' END AS error FROM tr LEFT JOIN bk ON bk.symbol = tr.symbol AND bk.slot = tr.slot)"""
_IN = lambda side, bps: f"list_filter({side}, lambda v: v.bps <= {bps})[-1]"
_AT = lambda side, bps: f"list_filter({side}, lambda v: v.bps = {bps})[1].cum"


def _slip(side: str, n: int) -> str:
    hit, before = f"list_filter({side}, lambda v: v.cum >= {n})[1]", f"list_filter({side}, lambda v: v.cum < {n})[-1]"
    lo, low = f"coalesce({before}.bps, 0)", f"coalesce({before}.cum, 0)"
    return f"{lo} + ({hit}.bps - {lo}) * ({n} - {low}) / ({hit}.cum - {low})"


_COLS = {"resolution_bps": "least(bids[1].bps, asks[1].bps)"}
for _n, _s, _a in (("bid", "bids", "sell"), ("ask", "asks", "buy")):
    for _b in M.LAUNCH_BANDS:
        _COLS |= {f"{_n}_depth_{_b}": f"{_IN(_s, _b)}.cum", f"{_n}_depth_{_b}_is_bound": f"CASE WHEN {_IN(_s, _b)} IS NOT NULL THEN {_IN(_s, _b)}.bps < {_b} END"}
    _COLS |= {f"{_n}_native_{_b}": _AT(_s, _b) for _b in (20, 100)}
    for _q in map(int, M.NOTIONALS):
        _COLS |= {f"{_a}_slippage_{_q}": _slip(_s, _q), f"{_a}_slippage_{_q}_bound": f"list_filter({_s}, lambda v: v.cum >= {_q})[1].bps"}
_COLS |= {f"imbalance_{_b}": f"({_IN('bids', _b)}.cum - {_IN('asks', _b)}.cum) / nullif({_IN('bids', _b)}.cum + {_IN('asks', _b)}.cum, 0)" for _b in (10, 20, 25)}
_DBL = " ".join(k for k in _COLS if "bound" not in k and k != "resolution_bps")
_LAUNCH = f"{_BOOK}, lf AS (SELECT symbol, slot, mid, spread, ok, error, {', '.join(f'CASE WHEN ok THEN {v} END AS {k}' for k, v in _COLS.items())} FROM j)"


def launch_books(spark, folder):
    """Cumulative notional in native bands of both sides, with mid and spread proxies from the trades of the slot."""
    t = ticks(spark, folder).withColumns({"slot": F.floor(F.col("ts_us") / SIX), "px": 100 + F.col("price") * 0.02})
    band = F.element_at(F.array(*map(F.lit, _BANDS)), (F.col("qty") % 6 + 1).cast("int"))
    b = t.where("qty % 7 > 0 AND (slot % 4 > 0 OR qty % 6 > 0)").groupBy("symbol", "slot", "is_sell", band.alias("bps")).agg(F.sum(F.col("price") * F.col("qty")).alias("n"))
    b = b.withColumn("cum", F.sum("n").over(Window.partitionBy("symbol", "slot", "is_sell").orderBy("bps")))  # six bands at most
    side = lambda keep: F.collect_list(F.when(keep, F.struct("bps", "cum")))
    some = lambda x: F.when(F.size(x) > 0, F.array_sort(x))
    b = b.groupBy("symbol", "slot").agg(side(~F.col("is_sell")).alias("bids"), side(F.col("is_sell")).alias("asks")).withColumns({"bids": some("bids"), "asks": some("asks")})
    sell, px = F.col("is_sell"), F.col("px")
    m = t.groupBy("symbol", "slot").agg((F.avg(F.when(~sell, px)) - F.avg(F.when(sell, px))).alias("gap")).join(exact_quantiles(t, ["symbol", "slot"], "px", {"mid": 0.5}), ["symbol", "slot"])
    m = m.withColumn("spread", F.when(F.col("gap").isNotNull(), F.greatest(div("gap", "mid") * 1e4, F.lit(0.0))))
    d = m.drop("gap").join(b, ["symbol", "slot"], "left")
    ok = F.col("bids").isNotNull() & F.col("asks").isNotNull()
    return d.withColumns({"ok": ok, "error": F.when(F.col("bids").isNull() != F.col("asks").isNull(), "one side empty")})


def launch_features(spark, folder):
    d = launch_books(spark, folder)
    return d.select("symbol", "slot", "mid", "spread", "ok", "error", *[v.alias(k) for k, v in M.launch_depth("bids", "asks", F.col("ok")).items()])


@query("launch_depth", "J28 J29 J27", f"WITH {_LAUNCH} SELECT * FROM lf", "mid spread " + _DBL, digits=4)
def launch_depth(spark, folder):
    return launch_features(spark, folder)


_THIN = "CASE WHEN resolution_bps = 20 THEN least(coalesce(bid_native_20, 0), coalesce(ask_native_20, 0)) ELSE least(coalesce(bid_native_100, 0), coalesce(ask_native_100, 0)) END"
_STATUS = f"""{_LAUNCH}, th AS (SELECT *, {_THIN} AS thin FROM lf), ca AS (SELECT *, CASE WHEN NOT ok AND error IS NOT NULL THEN 'BAD_BOOK' WHEN NOT ok THEN 'NO_DEPTH' WHEN thin < 1000 THEN 'DEPTH_TOO_THIN' WHEN spread > 50 THEN 'SPREAD_TOO_WIDE' WHEN spread IS NULL OR resolution_bps <> 20 THEN 'UNKNOWN' ELSE 'CAPACITY_OK' END AS status,
 CASE WHEN NOT ok THEN 0.0 ELSE 50 * least(greatest((log10(greatest(thin, 1)) - 2) / 2, 0), 1) * CASE WHEN resolution_bps = 20 THEN 1.0 ELSE 0.5 END + CASE WHEN spread IS NULL THEN 0 ELSE 50 * greatest(0, 1 - spread / 50) END END AS score FROM th)"""


def launch_capacity(spark, folder):
    d = launch_features(spark, folder)
    status, score = M.capacity_status("ok", "error", "resolution_bps", "bid_native_20", "ask_native_20", "bid_native_100", "ask_native_100", "spread")
    return d.withColumns({"status": status, "score": score})


@query("launch_capacity", "J31", f"WITH {_STATUS} SELECT symbol, slot, status, score FROM ca", "score", digits=4)
def launch_capacity_query(spark, folder):
    return launch_capacity(spark, folder).select("symbol", "slot", "status", "score")


@query("capacity_matrix", "J32", f"""WITH {_STATUS}, k AS (SELECT status, list(round(spread, 7) ORDER BY round(spread, 7)) FILTER (spread IS NOT NULL) AS l FROM ca GROUP BY 1)
SELECT ca.status, count(*) AS n, count(*) FILTER (ok) AS measured, avg(score) AS score, {', '.join(f'count(buy_slippage_{int(q)}) AS fills_{int(q)}' for q in M.NOTIONALS)}, count(spread) AS n_spreads, any_value(l[len(l) // 4 + 1]) AS spread_p25, any_value(l[len(l) // 2 + 1]) AS spread_median, any_value(l[3 * len(l) // 4 + 1]) AS spread_p75
 FROM ca JOIN k ON k.status = ca.status GROUP BY 1""", "score spread_p25 spread_median spread_p75", digits=4)
def capacity_matrix(spark, folder):
    d = launch_capacity(spark, folder)
    whole = d.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("measured"), F.avg("score").alias("score"), *[F.count(f"buy_slippage_{int(q)}").alias(f"fills_{int(q)}") for q in M.NOTIONALS], F.count("spread").alias("n_spreads"))
    # the spreads of a status by place, over many tasks
    r = d.where("spread IS NOT NULL").select("status", "symbol", "slot", F.round(F.col("spread") * 1e7).cast("bigint").alias("u"))
    r = number_rows(r, ["status"], ["u", "symbol", "slot"], 10_000_000).join(whole.select("status", "n_spreads"), "status")
    at = lambda k: F.max(F.when(F.col(RN) == F.floor(F.col("n_spreads") * k / 4), F.col("u"))) / 1e7
    q = r.groupBy("status").agg(at(1).alias("spread_p25"), at(2).alias("spread_median"), at(3).alias("spread_p75"))
    return whole.join(q, "status", "left")


_FR = f"""{TICKS}, q AS (SELECT symbol, ts_us // {DAY_US} AS slot, is_sell, CASE WHEN is_sell THEN 101 + floor(price) % 50 ELSE 100 - floor(price) % 50 END AS price, sum(qty)::DOUBLE AS qty, CASE WHEN sum(qty) % 5 > 0 THEN count(*) END AS orders FROM ticks GROUP BY 1, 2, 3, 4),
g AS (SELECT symbol, slot, (list({{'q': qty, 'o': orders}} ORDER BY price DESC) FILTER (NOT is_sell))[1:10] AS bids, (list({{'q': qty, 'o': orders}} ORDER BY price) FILTER (is_sell))[1:10] AS asks FROM q GROUP BY 1, 2),
k AS (SELECT symbol, slot, list_filter(bids, lambda v: v.o IS NOT NULL) AS bids, list_filter(asks, lambda v: v.o IS NOT NULL) AS asks FROM g),
o AS (SELECT *, list_sum(list_transform(bids, lambda v: v.o))::DOUBLE AS bid_orders, list_sum(list_transform(asks, lambda v: v.o))::DOUBLE AS ask_orders FROM k)"""


@query("book_fragmentation", "J13", f"WITH {_FR} SELECT symbol, slot, bid_orders, ask_orders, list_sum(list_transform(bids, lambda v: v.q)) / bid_orders AS bid_qty_per_order, list_sum(list_transform(asks, lambda v: v.q)) / ask_orders AS ask_qty_per_order, (bid_orders - ask_orders) / (bid_orders + ask_orders) AS order_imbalance FROM o",
       "bid_orders ask_orders bid_qty_per_order ask_qty_per_order order_imbalance")
def book_fragmentation(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.floor(F.col("ts_us") / DAY_US))
    cell = F.floor("price") % 50
    t = t.withColumn("price", F.when(F.col("is_sell"), 101 + cell).otherwise(100 - cell).cast("double"))
    q = t.groupBy("symbol", "slot", "is_sell", "price").agg(F.sum("qty").cast("double").alias("qty"), F.count(F.lit(1)).alias("orders")).withColumn("orders", F.when(F.col("qty") % 5 > 0, F.col("orders")))
    arr = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.struct("price", "qty", "orders"))))
    d = q.groupBy("symbol", "slot").agg(F.reverse(arr(~F.col("is_sell"))).alias("bids"), arr(F.col("is_sell")).alias("asks"))
    return d.select("symbol", "slot", *[v.alias(k) for k, v in M.fragmentation("bids", "asks").items()])
