"""Availability clocks, leak audits and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import row_hash
from tidemark.operators import pit
from tidemark.operators import rolling as R
from tidemark.operators.asof import asof_join
from tidemark.operators.blocks import DAYS, sequence
from tidemark.operators.crosssection import exact_quantiles
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, TICKS, bars, decisions, panel, ticks


@query("availability_clocks", "B1", f"""WITH {BARS} SELECT symbol, bar, bar + 3600000000 AS market_available, bar + 3600000000 + 108000000000 AS archive_published, bar + 3600000000 + 5000000 AS research_available, bar + 3600000000 + 108000000000 + 150000 AS execution_available FROM bars""")
def availability_clocks(spark, folder):
    return pit.availability(bars(spark, folder).select("symbol", "bar"), event="bar", kind="daily", live=True, bar_seconds=3600)


@query("archive_clocks", "B1", f"""WITH {TICKS} SELECT event_id, ts_us + 60000000 + 60000000 + 5000000 AS research_available, coalesce(CASE WHEN is_sell THEN ts_us + 1000000 END, ts_us + 120000000) + 150000 AS execution_available FROM ticks WHERE NOT is_sell
 UNION ALL SELECT event_id, ts_us + 1000000 + 5000000, ts_us + 1000000 + 150000 FROM ticks WHERE is_sell""")
def archive_clocks(spark, folder):
    t = ticks(spark, folder).withColumn("received", F.when(F.col("is_sell"), F.col("ts_us") + 1_000_000))
    d = pit.availability(t, event="ts_us", kind="snapshot", live=False, bar_seconds=60, received="received")
    return d.select("event_id", "research_available", "execution_available")


@query("publication_watermark", "B2", f"WITH {TICKS} SELECT event_id, (ts_us - 108000000000) // {DAY_US} * {DAY_US} - {HOUR_US} AS last_bar FROM ticks")
def publication_watermark(spark, folder):
    return ticks(spark, folder).select("event_id", pit.daily_watermark(F.col("ts_us"), 30 * HOUR_US, HOUR_US).alias("last_bar"))


_CLK = f"{TICKS}, a AS (SELECT symbol, event_id, ts_us, ts_us + (qty - 5) * 1000000 AS book_ts, ts_us - qty * 1000 AS trade_ts FROM ticks)"


def clocks(spark, folder):
    return ticks(spark, folder).select("symbol", "event_id", "ts_us", "price", (F.col("ts_us") + (F.col("qty") - 5) * 1_000_000).alias("book_ts"), (F.col("ts_us") - F.col("qty") * 1000).alias("trade_ts"),
                                       F.when(F.col("qty") > 50, F.col("qty")).alias("feature"))


@query("causality_report", "B3 B4", f"WITH {_CLK} SELECT count(*) AS n_rows, count(*) FILTER (book_ts > ts_us) AS late_book_ts, min(ts_us) FILTER (book_ts > ts_us) AS first_book_ts, count(*) FILTER (trade_ts > ts_us) AS late_trade_ts, min(ts_us) FILTER (trade_ts > ts_us) AS first_trade_ts FROM a")
def causality_report(spark, folder):
    return pit.causality_report(clocks(spark, folder), "ts_us", ["book_ts", "trade_ts"])


@query("causal_rows", "B3", f"WITH {_CLK} SELECT event_id FROM a")
def causal_rows(spark, folder):
    return pit.assert_causal(clocks(spark, folder), "ts_us", "trade_ts").select("event_id")


@query("latency_gate", "B5", f"WITH {TICKS}, l AS (SELECT venue, quantile_cont(qty, 0.95) AS p95 FROM ticks GROUP BY 1) SELECT venue, p95, p95 <= 400 / 4.0 AS passes FROM l", "p95")
def latency_gate(spark, folder):
    d = exact_quantiles(ticks(spark, folder).withColumn("x", F.col("qty").cast("double")), ["venue"], "x", {"p95": 0.95})
    return d.select("venue", "p95", (F.col("p95") <= 400 / 4.0).alias("passes"))


@query("pit_audit", "B6", f"""WITH {_CLK}, b AS (SELECT *, lag(book_ts) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) > book_ts AS back FROM a), d AS (SELECT symbol, book_ts, count(*) AS n FROM a GROUP BY 1, 2)
SELECT count(*) AS n_rows, count(*) FILTER (back) AS steps_back, count(*) FILTER (trade_ts > book_ts) AS late_trade_ts, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM d WHERE n > 1) AS duplicates FROM b""")
def pit_audit(spark, folder):
    return pit.audit(clocks(spark, folder), keys=["symbol"], asof="book_ts", order=["ts_us", "event_id"], clocks=["trade_ts"])


@query("provenance_audit", "B7", f"""WITH {_CLK}, f AS (SELECT a.*, CASE WHEN t.qty > 50 THEN t.qty END AS feature, t.price FROM a JOIN ticks t USING (event_id))
SELECT 'feature' AS feature, 'book_ts' AS clock, count(feature) AS present, count(*) FILTER (feature IS NOT NULL AND book_ts > ts_us) AS bad FROM f UNION ALL SELECT 'price', 'trade_ts', count(price), count(*) FILTER (trade_ts > ts_us) FROM f""")
def provenance_audit(spark, folder):
    return pit.provenance_audit(clocks(spark, folder), "ts_us", {"feature": "book_ts", "price": "trade_ts"})


@query("availability_from_age", "B8", f"WITH {TICKS} SELECT event_id, ts_us * 1000 - qty * 1000000 AS available_ns FROM ticks")
def availability_from_age(spark, folder):
    return ticks(spark, folder).select("event_id", (F.col("ts_us") * 1000 - F.col("qty") * 1_000_000).alias("available_ns"))


_STB = f"""{PANEL}, s AS (SELECT day, 'usd' AS coin, sum(qv) AS supply, max(abs(close / spot - 1)) AS depeg_max, avg(abs(close / spot - 1)) AS depeg_avg FROM panel GROUP BY day),
st AS (SELECT day, day + 1 AS available, supply, supply / lag(supply, 1) OVER w - 1 AS chg1, supply / lag(supply, 7) OVER w - 1 AS chg7, depeg_max, depeg_avg FROM s WINDOW w AS (ORDER BY day))"""


def stable_state(spark, folder):
    p = panel(spark, folder)
    off = F.abs(F.col("close") / F.col("spot") - 1)
    d = p.groupBy("day").agg(F.sum("qv").alias("supply"), F.max(off).alias("depeg_max"), F.avg(off).alias("depeg_avg")).withColumn("coin", F.lit("usd"))
    s = sequence(d, ["coin"], ["day"], back=8, bound=DAYS)
    return s.add({"available": F.col("day") + 1, "chg1": R.pct_change(s, "supply", 1), "chg7": R.pct_change(s, "supply", 7)}).result("day", "available", "supply", "chg1", "chg7", "depeg_max", "depeg_avg")


@query("pit_state_table", "B9", f"WITH {_STB} SELECT * FROM st", "supply chg1 chg7 depeg_max depeg_avg", digits=4)
def pit_state_table(spark, folder):
    return stable_state(spark, folder)


@query("pit_state_lookup", "B10", f"WITH {DECISIONS}, {_STB} SELECT d.id, st.available, st.chg7 FROM decisions d ASOF LEFT JOIN st ON d.ts_us // {DAY_US} >= st.available", "chg7")
def pit_state_lookup(spark, folder):
    d = decisions(spark, folder).select("id", F.floor(F.col("ts_us") / DAY_US).alias("day"))
    d = asof_join(d, stable_state(spark, folder).drop("day"), by=[], left_clock="day", right_clock="available", cols=["chg7"], prefix="s_", width=365)
    return d.select("id", F.col("s_available").alias("available"), F.col("s_chg7").alias("chg7"))


@query("provenance_segments", "B11", f"WITH {DECISIONS} SELECT CASE WHEN ts_us < 915148800000000 THEN 'backfill' ELSE 'forward' END AS segment, count(*) AS n FROM decisions GROUP BY 1")
def provenance_segments(spark, folder):
    return decisions(spark, folder).groupBy(pit.freeze_segment("ts_us", 915_148_800_000_000).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("event_ids", "B12 B13", f"WITH {DECISIONS} SELECT id, sha256('alpha|' || symbol || '|' || ts_us) AS event_id, sha256('alpha|' || ts_us || '|' || symbol || '|' || side) AS decision_key FROM decisions")
def event_ids(spark, folder):
    a = F.lit("alpha")
    return decisions(spark, folder).select("id", row_hash(a, "symbol", "ts_us").alias("event_id"), row_hash(a, "ts_us", "symbol", "side").alias("decision_key"))


@query("content_seal", "B14", f"""WITH {DECISIONS} SELECT id, sha256('{{"id":' || id || ',"side":' || side || ',"symbol":"' || symbol || '"}}') AS seal FROM decisions""")
def content_seal(spark, folder):
    d = decisions(spark, folder)
    return d.select("id", pit.seal(d, ["symbol", "id", "side"]).alias("seal"))


@query("append_unsealed", "B15", f"WITH {DECISIONS} SELECT id, symbol FROM decisions WHERE id NOT IN (SELECT id FROM decisions WHERE side = 1)")
def append_unsealed(spark, folder):
    d = decisions(spark, folder)
    return pit.unsealed_only(d.select("id", "symbol"), d.where("side = 1"), ["id"])
