"""As-of, interval and matching joins over the trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import rolling as R
from tidemark.operators.asof import Context, asof_contexts, asof_join, interval_sums, mutual_matches
from tidemark.operators.blocks import DAYS, sequence
from tidemark.operators.crosssection import exact_quantiles
from tidemark.operators.events import other_names_within, trailing_counts
from tidemark.operators.resample import HOUR_US, calendar
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, PANEL, TICKS, bars, panel, ticks

_SIDES = f"{TICKS}, l AS (SELECT * FROM ticks WHERE kind = 'purchase'), r AS (SELECT * FROM ticks WHERE kind = 'view')"


def _sides(spark, folder):
    t = ticks(spark, folder)
    return t.where("kind = 'purchase'"), t.where("kind = 'view'")


@query("asof_context", "C1", f"""WITH {_SIDES}, j AS (SELECT l.event_id, l.symbol, l.ts_us, r.price AS p, r.qty AS q, r.ts_us AS tt
 FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts_us >= r.ts_us)
SELECT event_id, symbol, ts_us, CASE WHEN ts_us - tt <= {6 * HOUR_US} THEN p END AS v_price, CASE WHEN ts_us - tt <= {6 * HOUR_US} THEN q END AS v_qty,
 CASE WHEN ts_us - tt <= {6 * HOUR_US} THEN tt END AS v_ts_us FROM j""", "v_price")
def asof_context(spark, folder):
    l, r = _sides(spark, folder)
    return asof_join(l.select("event_id", "symbol", "ts_us"), r, by=["symbol"], left_clock="ts_us", right_clock="ts_us",
                     cols=["price", "qty"], prefix="v_", tie=["event_id"], tolerance=6 * HOUR_US)


@query("asof_forward", "C8 C9", f"""WITH {_SIDES}, j AS (SELECT l.event_id, l.price, r.price AS p, r.ts_us AS rt, l.ts_us + {HOUR_US} AS want
 FROM (SELECT *, ts_us + {HOUR_US} AS tt FROM l) l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.tt <= r.ts_us)
SELECT event_id, price, CASE WHEN rt - want <= {4 * HOUR_US} THEN p END AS f_price FROM j""", "price f_price")
def asof_forward(spark, folder):
    l, r = _sides(spark, folder)
    l = l.select("event_id", "symbol", "price", (F.col("ts_us") + HOUR_US).alias("want"))
    d = asof_join(l, r, by=["symbol"], left_clock="want", right_clock="ts_us", cols=["price"], prefix="f_",
                  tie=["event_id"], direction="forward", tolerance=4 * HOUR_US)
    return d.select("event_id", "price", "f_price")


@query("asof_staleness_mask", "C2 C3 C4", f"""WITH {BARS}, r AS (SELECT * FROM ticks WHERE kind = 'error'),
j AS (SELECT b.symbol, b.bar, b.close, r.price AS p, (b.bar - r.ts_us) / 1000000.0 AS age FROM bars b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.bar >= r.ts_us)
SELECT symbol, bar, close, CASE WHEN age <= 36000 THEN p END AS funding, age AS age_sec FROM j""", "close funding age_sec")
def asof_staleness_mask(spark, folder):
    r = ticks(spark, folder).where("kind = 'error'")
    d = asof_join(bars(spark, folder).select("symbol", "bar", "close"), r, by=["symbol"], left_clock="bar", right_clock="ts_us",
                  cols=["price"], prefix="r_", tie=["event_id"])
    age = (F.col("bar") - F.col("r_ts_us")) / 1_000_000.0
    return d.select("symbol", "bar", "close", F.when(age <= 36_000, F.col("r_price")).alias("funding"), age.alias("age_sec"))


@query("master_frame", "C5 H51", f"""WITH {BARS}, f AS (SELECT * FROM ticks WHERE kind = 'error'), m AS (SELECT * FROM ticks WHERE kind = 'signup'),
s AS (SELECT * FROM ticks WHERE kind = 'view'),
a AS (SELECT b.symbol, b.bar, b.close, f.price AS funding FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.bar >= f.ts_us),
b2 AS (SELECT a.*, m.qty AS oi FROM a ASOF LEFT JOIN m ON a.symbol = m.symbol AND a.bar >= m.ts_us),
c3 AS (SELECT b2.*, s.price AS spot FROM b2 ASOF LEFT JOIN s ON b2.symbol = s.symbol AND b2.bar >= s.ts_us)
SELECT symbol, bar, close, funding, oi, spot, (close - spot) / nullif(spot, 0) AS basis FROM c3""", "close funding spot basis")
def master_frame(spark, folder):
    t = ticks(spark, folder)
    sides = [Context(t.where(F.col("kind") == kind).select("symbol", "ts_us", "event_id", F.col(col).alias(name)), "ts_us", [name], f"x{name}_", ["event_id"])
             for kind, col, name in (("error", "price", "funding"), ("signup", "qty", "oi"), ("view", "price", "spot"))]
    d = asof_contexts(bars(spark, folder).select("symbol", "bar", "close"), sides, by=["symbol"], left_clock="bar")
    d = d.select("symbol", "bar", "close", *[F.col(f"x{n}_{n}").alias(n) for n in ("funding", "oi", "spot")])
    return d.withColumn("basis", F.try_divide(F.col("close") - F.col("spot"), F.col("spot")))


@query("grid_asof", "C6", f"""WITH {TICKS}, g AS (SELECT symbol, unnest(generate_series((SELECT min(ts_us) - min(ts_us) % {HOUR_US} FROM ticks), (SELECT max(ts_us) FROM ticks), {HOUR_US})) AS slot
 FROM (SELECT DISTINCT symbol FROM ticks)),
j AS (SELECT g.symbol, g.slot, t.price, t.ts_us FROM g ASOF LEFT JOIN ticks t ON g.symbol = t.symbol AND g.slot >= t.ts_us)
SELECT symbol, slot, CASE WHEN slot - ts_us <= {2 * HOUR_US} THEN price END AS price FROM j""", "price")
def grid_asof(spark, folder):
    t = ticks(spark, folder)
    g = calendar(t.select("symbol", F.col("ts_us").alias("slot")), keys=["symbol"], clock="slot", step=HOUR_US)
    d = asof_join(g, t, by=["symbol"], left_clock="slot", right_clock="ts_us", cols=["price"], prefix="x_", tie=["event_id"], tolerance=2 * HOUR_US)
    return d.select("symbol", "slot", F.col("x_price").alias("price"))


@query("settlement_fill", "C7", f"""WITH {TICKS}, s AS (SELECT symbol, ts_us - ts_us % 300000000 AS paid, max_by(price, (ts_us, event_id)) AS rate FROM ticks WHERE kind = 'error' GROUP BY 1, 2),
g AS (SELECT DISTINCT symbol, ts_us - ts_us % 300000000 AS slot FROM ticks),
j AS (SELECT g.symbol, g.slot, s.rate, s.paid FROM g ASOF LEFT JOIN s ON g.symbol = s.symbol AND g.slot >= s.paid)
SELECT symbol, slot, rate, coalesce(paid = slot, false) AS is_settlement, greatest(slot - paid, 0) / 1000000.0 AS since_sec FROM j""", "rate since_sec")
def settlement_fill(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.col("ts_us") - F.pmod("ts_us", F.lit(300_000_000)))
    s = t.where("kind = 'error'").groupBy("symbol", F.col("slot").alias("at")).agg(F.max_by("price", F.struct("ts_us", "event_id")).alias("rate"))
    d = asof_join(t.select("symbol", "slot").distinct(), s, by=["symbol"], left_clock="slot", right_clock="at", cols=["rate"], prefix="x_")
    return d.select("symbol", "slot", F.col("x_rate").alias("rate"), F.coalesce(F.col("x_at") == F.col("slot"), F.lit(False)).alias("is_settlement"),
                    (F.greatest(F.col("slot") - F.col("x_at"), F.lit(0)) / 1_000_000.0).alias("since_sec"))


_MATCH = f"""WITH {_SIDES}, p AS (SELECT l.event_id AS a, r.event_id AS b, r.ts_us - l.ts_us AS off FROM l JOIN r ON l.symbol = r.symbol AND abs(r.ts_us - l.ts_us) <= 1800000000),
na AS (SELECT a, count(*) AS n FROM p GROUP BY a), nb AS (SELECT b, count(*) AS n FROM p GROUP BY b),
m AS (SELECT p.* FROM p JOIN na ON na.a = p.a AND na.n = 1 JOIN nb ON nb.b = p.b AND nb.n = 1),
s AS (SELECT l.event_id AS a_id, m.b AS b_id, m.off AS "offset", CASE WHEN m.b IS NOT NULL THEN 'matched' WHEN na.n IS NULL THEN 'unmatched' ELSE 'ambiguous' END AS status
 FROM l LEFT JOIN m ON m.a = l.event_id LEFT JOIN na ON na.a = l.event_id)"""


def _matches(spark, folder):
    l, r = _sides(spark, folder)
    r = r.select("symbol", F.col("ts_us").alias("r_us"), F.col("event_id").alias("r_id"))
    return mutual_matches(l.select("symbol", "ts_us", "event_id"), r, by=["symbol"], a_clock="ts_us", b_clock="r_us", a_id="event_id",
                          b_id="r_id", tolerance=1_800_000_000)


@query("mutual_match", "C10", _MATCH + ' SELECT a_id, b_id, "offset", status FROM s')
def mutual_match(spark, folder):
    return _matches(spark, folder).select("a_id", "b_id", "offset", "status")


@query("match_offsets", "C11", _MATCH + """ SELECT count(*) AS n, quantile_cont(abs("offset") / 1e6, 0.5) AS p50, quantile_cont(abs("offset") / 1e6, 0.95) AS p95,
 quantile_cont(abs("offset") / 1e6, 0.99) AS p99, max(abs("offset") / 1e6) AS worst FROM s WHERE status = 'matched'""", "p50 p95 p99 worst", digits=4)
def match_offsets(spark, folder):
    d = _matches(spark, folder).where("status = 'matched'").select((F.abs("offset") / 1e6).alias("x"))
    q = exact_quantiles(d.withColumn("g", F.lit(0)), ["g"], "x", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    m = d.agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("worst")).withColumn("g", F.lit(0))
    return m.join(q, "g", "left").drop("g")  # without a match there are no quantiles, but still a count


@query("prevailing_quote", "C12 J25", f"""WITH {_SIDES}, j AS (SELECT l.event_id, l.symbol, l.price, r.price AS q, r.qty AS k FROM l ASOF JOIN r ON l.symbol = r.symbol AND l.ts_us >= r.ts_us)
SELECT symbol, count(*) AS n, avg(abs(price - q) / q) AS effective_half, avg(CAST(k AS DOUBLE) / q) AS quoted_half,
 avg(CASE WHEN abs(price - q) <= k THEN 1.0 ELSE 0 END) AS at_touch FROM j GROUP BY symbol""", "effective_half quoted_half at_touch")
def prevailing_quote(spark, folder):
    l, r = _sides(spark, folder)
    d = asof_join(l.select("event_id", "symbol", "ts_us", "price"), r, by=["symbol"], left_clock="ts_us", right_clock="ts_us",
                  cols=["price", "qty"], prefix="q_", tie=["event_id"]).where(F.col("q_price").isNotNull())
    gap = F.abs(F.col("price") - F.col("q_price"))
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap / F.col("q_price")).alias("effective_half"), F.avg(F.col("q_qty") / F.col("q_price")).alias("quoted_half"),
        F.avg(F.when(gap <= F.col("q_qty"), 1.0).otherwise(0.0)).alias("at_touch"))


@query("trailing_event_counts", "C13", f"""WITH {TICKS}, e AS (SELECT * FROM ticks WHERE kind = 'error')
SELECT event_id, symbol, CAST(count(*) OVER (ORDER BY ts_us RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_all_30m,
 CAST(count(*) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {DAY_US} PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_own_24h FROM e""")
def trailing_event_counts(spark, folder):
    e = ticks(spark, folder).where("kind = 'error'").select("event_id", "symbol", "ts_us")
    d = trailing_counts(e, [], "ts_us", 1_800_000_000, "n_all_30m")
    d = trailing_counts(d, ["symbol"], "ts_us", DAY_US, "n_own_24h")
    return d.select("event_id", "symbol", F.col("n_all_30m").cast("bigint").alias("n_all_30m"), F.col("n_own_24h").cast("bigint").alias("n_own_24h"))


@query("other_symbol_density", "C14", f"""WITH {TICKS}, e AS (SELECT * FROM ticks WHERE kind = 'error')
SELECT a.event_id, a.symbol, count(DISTINCT b.symbol) AS density FROM e a LEFT JOIN e b ON b.symbol <> a.symbol AND b.ts_us < a.ts_us AND b.ts_us > a.ts_us - {HOUR_US}
GROUP BY a.event_id, a.symbol""")
def other_symbol_density(spark, folder):
    e = ticks(spark, folder).where("kind = 'error'").select("event_id", "symbol", "ts_us")
    return other_names_within(e, "symbol", "ts_us", HOUR_US, "density").select("event_id", "symbol", "density")


_HOLD = f"""WITH {_SIDES}, h AS (SELECT event_id, symbol, is_sell, price, ts_us AS entry, ts_us + {12 * HOUR_US} AS exit FROM l)"""


def _holds(spark, folder):
    l, r = _sides(spark, folder)
    return l.select("event_id", "symbol", "price", F.col("ts_us").alias("entry"), (F.col("ts_us") + 12 * HOUR_US).alias("exit")), r


@query("settlements_between", "C15", _HOLD + """ SELECT h.event_id, count(r.event_id) AS n, coalesce(sum(r.qty), 0)::BIGINT AS qty FROM h LEFT JOIN r
 ON r.symbol = h.symbol AND r.ts_us > h.entry AND r.ts_us <= h.exit GROUP BY h.event_id""")
def settlements_between(spark, folder):
    h, r = _holds(spark, folder)
    d = interval_sums(h, r.select("symbol", "ts_us", "qty"), by=["symbol"], lo=F.col("entry"), hi=F.col("exit"), right_clock="ts_us",
                      values={"n": F.lit(1), "qty": F.col("qty")})
    return d.select("event_id", F.col("n").cast("bigint").alias("n"), F.col("qty").cast("bigint").alias("qty"))


@query("crosses_settlement", "C16", _HOLD + f" SELECT event_id, entry // {8 * HOUR_US} < exit // {8 * HOUR_US} AS crosses_12h, entry // {8 * HOUR_US} < (entry + {HOUR_US}) // {8 * HOUR_US} AS crosses_1h FROM h")
def crosses_settlement(spark, folder):
    h, _ = _holds(spark, folder)
    mark = lambda x: F.floor(x / (8 * HOUR_US))
    return h.select("event_id", (mark(F.col("exit")) > mark(F.col("entry"))).alias("crosses_12h"),
                    (mark(F.col("entry") + HOUR_US) > mark(F.col("entry"))).alias("crosses_1h"))


@query("holding_funding_cost", "C17", _HOLD + """ SELECT h.event_id, -coalesce(sum(r.qty), 0) / 10000.0 * max(h.price) AS long_cost, coalesce(sum(r.qty), 0) / 10000.0 * max(h.price) AS short_cost
 FROM h LEFT JOIN r ON r.symbol = h.symbol AND r.ts_us > h.entry AND r.ts_us <= h.exit GROUP BY h.event_id""", "long_cost short_cost")
def holding_funding_cost(spark, folder):
    h, r = _holds(spark, folder)
    d = interval_sums(h, r.select("symbol", "ts_us", "qty"), by=["symbol"], lo=F.col("entry"), hi=F.col("exit"), right_clock="ts_us",
                      values={"rate": F.col("qty")})
    paid = F.col("rate") / 10000.0 * F.col("price")
    return d.select("event_id", (-paid).alias("long_cost"), paid.alias("short_cost"))


@query("plane_merge", "C18", f"""WITH {BARS} SELECT b.symbol, b.bar, b.close, f.volume AS flow_volume, f.trades AS flow_trades FROM bars b LEFT JOIN (SELECT symbol, bar, volume, trades FROM bars WHERE trades > 1) f
 ON f.symbol = b.symbol AND f.bar = b.bar""", "close flow_volume flow_trades")
def plane_merge(spark, folder):
    from tidemark.operators.pit import merge_planes
    b = bars(spark, folder)
    flow = b.where("trades > 1").select("symbol", "bar", F.col("volume").alias("flow_volume"), F.col("trades").alias("flow_trades"))
    return merge_planes(b.select("symbol", "bar", "close"), [flow], ["symbol", "bar"])


@query("basis_panel", "C19", f"""WITH {PANEL}, p AS (SELECT day, symbol, close AS perp, spot, close / spot - 1 AS basis FROM panel WHERE spot IS NOT NULL)
SELECT day, symbol, basis, basis - lag(basis, 1) OVER o AS d1, basis - lag(basis, 3) OVER o AS d3, basis - lag(basis, 12) OVER o AS d12,
 CASE WHEN count(basis) OVER w = 48 THEN (basis - avg(basis) OVER w) / nullif(stddev_samp(basis) OVER w, 0) END AS z48
FROM p WINDOW o AS (PARTITION BY symbol ORDER BY day), w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)""", "basis d1 d3 d12 z48")
def basis_panel(spark, folder):
    p = panel(spark, folder)
    perp, spot = p.select("day", "symbol", F.col("close").alias("perp")), p.select("day", "symbol", "spot")
    d = perp.join(spot, ["day", "symbol"]).withColumn("basis", F.col("perp") / F.col("spot") - 1)
    s = sequence(d, ["symbol"], ["day"], back=50, bound=DAYS)
    return s.add({"d1": R.change(s, "basis", 1), "d3": R.change(s, "basis", 3), "d12": R.change(s, "basis", 12),
                  "z48": R.prior_z(s, "basis", 48)}).result("day", "symbol", "basis", "d1", "d3", "d12", "z48")


@query("cross_venue_funding", "C20 I20", f"""WITH {TICKS}, v AS (SELECT symbol, ts_us // {8 * HOUR_US} AS slot, venue, avg(price) AS rate FROM ticks GROUP BY 1, 2, 3),
j AS (SELECT a.symbol, a.slot, a.rate AS ra, b.rate AS rb FROM v a JOIN v b ON a.symbol = b.symbol AND a.slot = b.slot AND a.venue = 0 AND b.venue = 1)
SELECT symbol, slot, ra, rb, ra - rb AS spread, (ra + rb) / 2 AS consensus, least(ra, rb) AS low_rate, greatest(ra, rb) AS high_rate,
 CASE WHEN count(*) OVER w >= 10 THEN (ra - rb - avg(ra - rb) OVER w) / nullif(stddev_samp(ra - rb) OVER w, 0) END AS spread_z FROM j
 WINDOW w AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", "ra rb spread consensus low_rate high_rate spread_z")
def cross_venue_funding(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.floor(F.col("ts_us") / (8 * HOUR_US)))
    side = lambda v, name: t.where(F.col("venue") == v).groupBy("symbol", "slot").agg(F.avg("price").alias(name))
    d = side(0, "ra").join(side(1, "rb"), ["symbol", "slot"]).withColumns({
        "spread": F.col("ra") - F.col("rb"), "consensus": (F.col("ra") + F.col("rb")) / 2,
        "low_rate": F.least("ra", "rb"), "high_rate": F.greatest("ra", "rb")})
    s = sequence(d, ["symbol"], ["slot"], back=30)
    return s.add({"spread_z": R.z_plain(s, "spread", 30, 10)}).result()
