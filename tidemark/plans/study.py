"""The flagship query: an event study from raw trades to episode statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import div, ind
from tidemark.operators import rolling as R
from tidemark.operators.blocks import HOURS, sequence
from tidemark.operators.events import cooldown
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, bars

_EVENTS = f"""WITH RECURSIVE {BARS},
r AS (SELECT *, ln(close / lag(close) OVER w) AS ret, ln(lead(close, 4) OVER w / close) AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
z AS (SELECT *, CASE WHEN count(ret) OVER p >= 8 THEN (ret - avg(ret) OVER p) / nullif(stddev_samp(ret) OVER p, 0) END AS z
 FROM r WINDOW p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
t AS (SELECT * FROM z WHERE abs(z) >= 1.5 AND fwd IS NOT NULL),
k AS (SELECT symbol, min(bar) AS bar FROM t GROUP BY symbol
 UNION ALL SELECT k.symbol, (SELECT min(t.bar) FROM t WHERE t.symbol = k.symbol AND t.bar >= k.bar + 12 * {HOUR_US}) FROM k WHERE k.bar IS NOT NULL),
e AS (SELECT t.* FROM t JOIN k ON t.symbol = k.symbol AND t.bar = k.bar)"""


def study_events(spark, folder):
    s = sequence(bars(spark, folder), ["symbol"], ["bar"], back=30, ahead=4, bound=HOURS)
    s = s.add({"ret": F.ln(F.col("close") / R.lag(s, "close")), "fwd": F.ln(R.lag(s, "close", -4) / F.col("close"))})
    s = s.add({"z": R.prior_z(s, "ret", 24, 8)})
    hits = s.result().where((F.abs("z") >= 1.5) & F.col("fwd").isNotNull())
    return cooldown(hits, ["symbol"], "bar", 12 * HOUR_US)


@query("event_study", "K1 E1 M1 N17 N22", _EVENTS + """,
g AS (SELECT *, -sign(z) * fwd * 10000 AS gross FROM e)
SELECT symbol, count(*) AS n, avg(gross) AS mean_bps, avg(gross) / nullif(stddev_samp(gross), 0) * sqrt(count(*)) AS t_stat,
 sum(CASE WHEN gross > 0 THEN gross ELSE 0 END) / nullif(-sum(CASE WHEN gross < 0 THEN gross ELSE 0 END), 0) AS profit_factor,
 avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0 END) AS hit_rate FROM g GROUP BY symbol""", "mean_bps t_stat profit_factor hit_rate")
def event_study(spark, folder):
    g = -F.signum("z") * F.col("fwd") * 10_000
    d = study_events(spark, folder).withColumn("gross", g)
    x = F.col("gross")
    return d.groupBy("symbol").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean_bps"),
        (div(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.count(x))).alias("t_stat"),
        div(F.sum(ind(x > 0, x)), -F.sum(ind(x < 0, x))).alias("profit_factor"),
        F.avg(ind(x > 0)).alias("hit_rate"))


@query("event_cooldown", "K1", _EVENTS + " SELECT symbol, bar, z, fwd FROM e", "z fwd")
def event_cooldown(spark, folder):
    return study_events(spark, folder).select("symbol", "bar", "z", "fwd")
