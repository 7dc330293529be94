"""Data quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import div, ind
from tidemark.operators import quality as Q
from tidemark.operators import rolling as R
from tidemark.operators.blocks import HOURS, sequence
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, TICKS, bars, decisions, panel, read, ticks

_BO = "(PARTITION BY symbol ORDER BY bar)"


@query("frame_gate", "P1 P6 P7", f"""WITH {BARS}, g AS (SELECT *, bar - lag(bar) OVER {_BO} AS gap FROM bars) SELECT count(*) AS n_rows, count(*) FILTER (gap > {int(1.5 * HOUR_US)}) AS n_gaps, count(*) FILTER (gap = 0) AS n_repeated, count(*) FILTER (close IS NULL) AS null_close, min(close) = max(close) AS constant_close,
 count(*) FILTER (volume IS NULL) AS null_volume, min(volume) = max(volume) AS constant_volume FROM g""")
def frame_gate(spark, folder):
    return Q.frame_gate(bars(spark, folder), key="symbol", clock="bar", arrival=["bar"], values=["close", "volume"], step=HOUR_US)


@query("series_coverage", "P2", f"""WITH {BARS}, g AS (SELECT symbol, bar, bar - lag(bar) OVER {_BO} AS gap FROM bars), s AS (SELECT symbol, min(bar) AS first, max(bar) AS last, count(*) AS actual, count(*) FILTER (gap > {int(1.5 * HOUR_US)}) AS n_gaps, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY 1)
SELECT *, (last - first) // {HOUR_US} + 1 AS expected, actual / ((last - first) // {HOUR_US} + 1) AS coverage FROM s""", "coverage")
def series_coverage(spark, folder):
    return Q.series_coverage(bars(spark, folder), key="symbol", clock="bar", step=HOUR_US)


_GAPS = f"""{BARS}, g AS (SELECT symbol, lag(bar) OVER {_BO} AS gap_from, bar AS gap_to FROM bars), gp AS (SELECT symbol, gap_from, gap_to, (gap_to - gap_from) // {HOUR_US} - 1 AS missing FROM g WHERE gap_to - gap_from > {int(1.5 * HOUR_US)})"""


@query("gap_list", "P11", f"WITH {_GAPS} SELECT symbol, gap_from, gap_to, missing FROM gp")
def gap_list(spark, folder):
    return Q.gaps(bars(spark, folder), key="symbol", clock="bar", step=HOUR_US)


@query("unfillable_gaps", "P3 P4", f"""WITH {_GAPS}, m AS (SELECT DISTINCT user_id % 16 AS s, epoch_us(ts) // {DAY_US} AS day FROM events WHERE event_type = 'view' AND value > 0), d AS (SELECT symbol, gap_from, gap_to, unnest(generate_series(gap_from // {DAY_US}, gap_to // {DAY_US})) AS day FROM gp)
SELECT d.symbol, d.gap_from, count(*) AS n_days, count(*) FILTER (m.day IS NULL) AS n_absent, count(*) FILTER (m.day IS NULL) = count(*) AS confirmed FROM d LEFT JOIN m ON 'S' || lpad(CAST(m.s AS VARCHAR), 2, '0') = d.symbol AND m.day = d.day GROUP BY 1, 2""")
def unfillable_gaps(spark, folder):
    g = Q.gaps(bars(spark, folder), key="symbol", clock="bar", step=HOUR_US)
    day = lambda x: F.floor(F.col(x) / DAY_US)
    have = ticks(spark, folder).where("kind = 'view'").select("symbol", day("ts_us").alias("day")).distinct().withColumn("_h", F.lit(True))
    d = g.withColumn("day", F.explode(F.sequence(day("gap_from"), day("gap_to")))).join(have, ["symbol", "day"], "left")
    no = F.count(F.when(F.col("_h").isNull(), 1))
    return d.groupBy("symbol", "gap_from").agg(F.count(F.lit(1)).alias("n_days"), no.alias("n_absent"), (no == F.count(F.lit(1))).alias("confirmed"))


@query("readiness_matrix", "P5 P14", f"""WITH {BARS}, s AS (SELECT symbol, count(*) AS n, count(*) / ((max(bar) - min(bar)) // {HOUR_US} + 1) AS cov, avg(volume) AS v FROM bars GROUP BY 1)
SELECT symbol, array_to_string(list_filter([CASE WHEN cov < 0.58 THEN 'coverage' END, CASE WHEN n < 415 THEN 'rows' END, CASE WHEN v < 72 THEN 'volume' END], lambda q: q IS NOT NULL), ',') AS reasons, CASE WHEN cov >= 0.58 AND n >= 415 AND v >= 72 THEN 'PASS' ELSE 'FAIL' END AS status FROM s""")
def readiness_matrix(spark, folder):
    d = bars(spark, folder).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("v"), ((F.max("bar") - F.min("bar")) / HOUR_US + 1).alias("e"))
    need = {"coverage": F.col("n") / F.col("e") >= 0.58, "rows": F.col("n") >= 415, "volume": F.col("v") >= 72}
    why = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in need.items()]))
    return d.select("symbol", F.concat_ws(",", why).alias("reasons"), F.when(F.size(why) == 0, "PASS").otherwise("FAIL").alias("status"))


@query("placeholder_flow", "P8", f"WITH {BARS} SELECT symbol, avg(CASE WHEN abs(taker_buy_base - 0.5 * volume) < 1e-9 THEN 1.0 ELSE 0 END) AS share, avg(CASE WHEN abs(taker_buy_base - 0.5 * volume) < 1e-9 THEN 1.0 ELSE 0 END) > 0.5 AS placeholder FROM bars GROUP BY symbol", "share")
def placeholder_flow(spark, folder):
    share = F.avg(ind(F.abs(F.col("taker_buy_base") - 0.5 * F.col("volume")) < 1e-9))
    return bars(spark, folder).groupBy("symbol").agg(share.alias("share"), (share > 0.5).alias("placeholder"))


@query("bar_consistency", "P9 P10 P12", f"""WITH {BARS}, g AS (SELECT *, abs(close / lag(close) OVER {_BO} - 1) > 3 AS jump FROM bars) SELECT symbol, count(*) FILTER (high < greatest(open, close, low)) AS bad_high, count(*) FILTER (low > least(open, close, high)) AS bad_low, count(*) FILTER (open <= 0 OR low <= 0) AS not_positive,
 count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (jump) AS jumps, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM g GROUP BY 1""", "null_rate")
def bar_consistency(spark, folder):
    s = sequence(bars(spark, folder), ["symbol"], ["bar"], back=1, bound=HOURS)
    d = s.add({"jump": F.abs(R.pct_change(s, "close")) > 3}).result()
    return d.groupBy("symbol").agg(*[Q.count_if(v).alias(k) for k, v in Q.bar_checks().items()], Q.count_if(F.col("jump")).alias("jumps"), F.avg(ind(F.col("close").isNull())).alias("null_rate"))


@query("future_timestamps", "P13", f"WITH {TICKS}, n AS (SELECT quantile_cont(ts_us, 0.5)::BIGINT AS now_us FROM ticks WHERE event_id = 0) SELECT event_id FROM ticks, n WHERE ts_us > now_us + {20 * DAY_US}")
def future_timestamps(spark, folder):
    t = ticks(spark, folder)
    now = t.where("event_id = 0").agg(F.max("ts_us").alias("now")).first()["now"]  # null on a table without that row: then nothing is late
    return t.where(F.col("ts_us") > F.lit(now) + 20 * DAY_US).select("event_id")


@query("feed_status_coverage", "P15 P17", f"WITH {TICKS} SELECT kind, count(*) AS n, count(DISTINCT symbol) AS symbols, max(ts_us) AS last_us, count(*) / sum(count(*)) OVER () AS share FROM ticks GROUP BY kind", "share")
def feed_status_coverage(spark, folder):
    d = ticks(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), F.max("ts_us").alias("last_us"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per feed


@query("source_freshness", "P16", f"""WITH {TICKS}, d AS (SELECT kind, ts_us // {DAY_US} AS day, count(*) AS n FROM ticks GROUP BY 1, 2), z AS (SELECT *, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS z, row_number() OVER (PARTITION BY kind ORDER BY day DESC) AS k FROM d WINDOW w AS (PARTITION BY kind ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT kind, day, n, z FROM z WHERE k = 1""", "z")
def source_freshness(spark, folder):
    d = ticks(spark, folder).groupBy("kind", F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per feed and day
    d = d.withColumns({"z": div(F.col("n") - F.avg("n").over(w), F.stddev_samp("n").over(w)), "k": F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("day")))})
    return d.where("k = 1").select("kind", "day", "n", "z")


@query("completeness_score", "P18", "SELECT lang, avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0 END) AS share_long, avg(CASE WHEN l.quality IS NOT NULL THEN 1.0 ELSE 0 END) AS share_quality, (avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0 END) + avg(CASE WHEN l.quality IS NOT NULL THEN 1.0 ELSE 0 END)) / 2 AS completeness FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1", "share_long share_quality completeness")
def completeness_score(spark, folder):
    d = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id", "left").withColumn("long", F.when(F.col("n_chars") > 500, 1))
    return Q.completeness(d, ["long", "quality"], ["lang"])


@query("distribution_compare", "P19", f"""WITH {DECISIONS}, u AS (SELECT CASE WHEN year < 1998 THEN 'old' ELSE 'new' END AS part, gross_bps FROM decisions) SELECT part, count(*) AS n, avg(gross_bps) AS mean, stddev_samp(gross_bps) AS sd, quantile_cont(gross_bps, 0.05) AS p05, quantile_cont(gross_bps, 0.5) AS p50, quantile_cont(gross_bps, 0.95) AS p95 FROM u GROUP BY 1""", "mean sd p05 p50 p95")
def distribution_compare(spark, folder):
    from tidemark.operators.crosssection import exact_quantiles
    d = decisions(spark, folder).withColumn("part", F.when(F.col("year") < 1998, "old").otherwise("new"))
    q = exact_quantiles(d, ["part"], "gross_bps", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_bps").alias("mean"), F.stddev_samp("gross_bps").alias("sd")).join(q, "part")


@query("window_file_coverage", "P20 P21", f"""WITH {TICKS}, e AS (SELECT event_id, symbol, unnest(generate_series((ts_us - {DAY_US}) // {DAY_US}, (ts_us + {DAY_US}) // {DAY_US})) AS day FROM ticks WHERE kind = 'signup'), h AS (SELECT DISTINCT symbol, ts_us // {DAY_US} AS day FROM ticks WHERE kind = 'view')
SELECT e.event_id, count(*) AS expected, avg(CASE WHEN h.day IS NULL THEN 0 ELSE 1.0 END) AS coverage FROM e LEFT JOIN h ON h.symbol = e.symbol AND h.day = e.day GROUP BY 1""", "coverage")
def window_file_coverage(spark, folder):
    t = ticks(spark, folder)
    day = lambda x: F.floor(x / DAY_US)
    e = t.where("kind = 'signup'").select("event_id", "symbol", F.explode(F.sequence(day(F.col("ts_us") - DAY_US), day(F.col("ts_us") + DAY_US))).alias("day"))
    h = t.where("kind = 'view'").select("symbol", day(F.col("ts_us")).alias("day")).distinct().withColumn("_h", F.lit(True))
    return e.join(h, ["symbol", "day"], "left").groupBy("event_id").agg(F.count(F.lit(1)).alias("expected"), F.avg(ind(F.col("_h"))).alias("coverage"))


@query("universe_drift", "P22", f"WITH {PANEL}, a AS (SELECT DISTINCT symbol FROM panel WHERE qv > 60000 AND day < 9300), b AS (SELECT DISTINCT symbol FROM panel WHERE qv > 60000 AND day > 11500) SELECT symbol, 'gone' AS side FROM a WHERE symbol NOT IN (SELECT symbol FROM b) UNION ALL SELECT symbol, 'new' FROM b WHERE symbol NOT IN (SELECT symbol FROM a)")
def universe_drift(spark, folder):
    p = panel(spark, folder).where("qv > 60000")
    return Q.set_drift(p.where("day < 9300").select("symbol").distinct(), p.where("day > 11500").select("symbol").distinct(), "symbol")
