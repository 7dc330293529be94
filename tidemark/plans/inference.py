"""Validation metrics, multiplicity, placebos, bootstraps and model checks."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, div, draw, ind
from tidemark.operators import rolling as R
from tidemark.operators import stats as S
from tidemark.operators.blocks import DAYS, RN, number_rows, sequence
from tidemark.operators.crosssection import average_rank, exact_quantiles, partial_rank_correlation, spearman
from tidemark.operators.events import fixed_window_ids, greedy_anchors, session_ids
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, TICKS, bars, decisions, panel, read, ticks
from tidemark.plans.windows import _MKT, _ORD, _RET, market_panel, ret_bars
from tidemark.session import pin

WEEK = 7 * DAY_US
_EP = f"{DECISIONS}, d AS (SELECT *, ts_us // {WEEK} AS ep FROM decisions), e AS (SELECT symbol, ep, avg(gross_bps) AS m, sum(gross_bps) AS s, count(*) AS n FROM d GROUP BY 1, 2)"
_DRAW = lambda *parts: "CAST('0x' || left(md5(concat_ws('|', " + ", ".join(parts) + ")), 8) AS BIGINT)"
_PFACT = lambda x, f="": f"(sum(CASE WHEN {x} > 0 THEN {x} ELSE 0 END) / nullif(-sum(CASE WHEN {x} < 0 THEN {x} ELSE 0 END), 0))"


def episodes(spark, folder):
    return decisions(spark, folder).withColumn("ep", fixed_window_ids("ts_us", WEEK))


@query("episode_metrics", "N17 N22 N60", f"""WITH {_EP}, a AS (SELECT symbol, count(m) AS n_independent, avg(m) AS gross_edge, avg(m) / stddev_samp(m) * sqrt(count(m)) AS t_stat, stddev_samp(m) AS sigma, stddev_samp(CASE WHEN m - 4 < 0 THEN m - 4 END) AS dn FROM e GROUP BY 1),
b AS (SELECT symbol, count(*) AS n_raw, {_PFACT('gross_bps')} AS pf_gross, {_PFACT('(gross_bps - 4)')} AS pf_net, {_PFACT('(gross_bps - 8)')} AS pf_net_x2, avg(CASE WHEN gross_bps - 4 > 0 THEN 1.0 ELSE 0 END) AS hit_rate, (max(ts_us) - min(ts_us)) / 31557600000000.0 AS years FROM d GROUP BY 1)
SELECT a.symbol, n_independent, gross_edge, t_stat, sigma, n_raw, pf_gross, pf_net, pf_net_x2, hit_rate, gross_edge - 4 AS net_edge, gross_edge - 8 AS net_edge_x2, (gross_edge - 4) / sigma * sqrt(n_independent / years) AS sharpe,
 (gross_edge - 4) / dn * sqrt(n_independent / years) AS sortino FROM a JOIN b USING (symbol)""", "gross_edge t_stat sigma pf_gross pf_net pf_net_x2 hit_rate net_edge net_edge_x2 sharpe sortino")
def episode_metrics(spark, folder):
    return S.metrics(episodes(spark, folder), ["symbol"], "ep", "gross_bps", "ts_us", 4.0)


@query("decluster_methods", "K30 K31 K32 K33 K34 K35", f"""WITH RECURSIVE {DECISIONS}, u AS (SELECT DISTINCT symbol, ts_us FROM decisions), f AS (SELECT symbol, count(DISTINCT ts_us // {WEEK}) AS n_fixed FROM u GROUP BY 1),
l AS (SELECT symbol, 1 + count(*) FILTER (ts_us - p > {WEEK}) AS n_chain FROM (SELECT *, lag(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us) AS p FROM u) GROUP BY 1),
k AS (SELECT symbol, min(ts_us) AS t FROM u GROUP BY symbol UNION ALL SELECT k.symbol, (SELECT min(u.ts_us) FROM u WHERE u.symbol = k.symbol AND u.ts_us > k.t + {WEEK}) FROM k WHERE k.t IS NOT NULL),
a AS (SELECT symbol, count(t) AS n_anchored FROM k GROUP BY 1)
SELECT f.symbol, n_fixed, n_chain, n_anchored FROM f JOIN l USING (symbol) JOIN a USING (symbol)""")
def decluster_methods(spark, folder):
    d = decisions(spark, folder).select("symbol", "ts_us").distinct()
    fixed = d.groupBy("symbol").agg(F.countDistinct(fixed_window_ids("ts_us", WEEK)).alias("n_fixed"))
    chain = session_ids(d, ["symbol"], "ts_us", ["ts_us"], WEEK, "ep", 1000 * DAY_US).groupBy("symbol").agg((F.max("ep") + 1).alias("n_chain"))
    anchored = greedy_anchors(d, ["symbol"], "ts_us", WEEK, strict=True).groupBy("symbol").agg(F.countDistinct("anchor").alias("n_anchored"))
    return fixed.join(chain, "symbol").join(anchored, "symbol")


@query("leave_one_out", "N18", f"WITH {DECISIONS}, g AS (SELECT symbol, sum(gross_bps) AS s, count(*) AS n FROM decisions GROUP BY 1) SELECT symbol, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS mean_without FROM g", "mean_without")
def leave_one_out(spark, folder):
    return S.without_one(decisions(spark, folder), "symbol", "gross_bps")


@query("robustness_gate", "N19 N20 N25 N30 B5", f"""WITH {_EP}, a AS (SELECT symbol, count(m) AS n, avg(m) AS edge, avg(m) / stddev_samp(m) * sqrt(count(m)) AS t, stddev_samp(m) / sqrt(count(m)) AS se FROM e GROUP BY 1)
SELECT symbol, n, 3.0 * se AS min_edge, edge >= 2.0 * 4 AS passes_wall, array_to_string(list_filter([CASE WHEN NOT n >= 100 THEN 'count' END, CASE WHEN NOT edge > 4 THEN 'edge' END, CASE WHEN NOT abs(t) >= 2 THEN 't' END], lambda q: q IS NOT NULL), ',') AS failures FROM a""", "min_edge")
def robustness_gate(spark, folder):
    e = S.episode_means(episodes(spark, folder), ["symbol"], "ep", "gross_bps")
    x = F.col("ep_mean")
    a = e.groupBy("symbol").agg(F.count(x).alias("n"), F.avg(x).alias("edge"), S.t_stat(x).alias("t"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"))
    fails = S.robust_failures(count=F.col("n") >= 100, edge=F.col("edge") > 4, t=F.abs("t") >= 2)
    return a.select("symbol", "n", (3.0 * F.col("se")).alias("min_edge"), (F.col("edge") >= 8.0).alias("passes_wall"), F.concat_ws(",", fails).alias("failures"))


@query("cost_sensitivity", "N23 N24 N59 N67", f"""WITH {DECISIONS}, m AS (SELECT unnest([0.5, 1.0, 2.0, 3.0]) AS mult) SELECT tier, mult, 2 * (0.3 * 2 + 0.7 * 5) + 1.5 AS round_trip, avg(gross_bps - mult * (2 * (0.3 * 2 + 0.7 * 5) + 1.5)) AS net, {_PFACT('(gross_bps - mult * 9.7)')} AS pf FROM decisions CROSS JOIN m GROUP BY 1, 2""", "mult round_trip net pf")
def cost_sensitivity(spark, folder):
    trip = 2 * (0.3 * 2 + 0.7 * 5) + 1.5
    d = decisions(spark, folder).withColumn("mult", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0, 3.0)])))
    net = F.col("gross_bps") - F.col("mult") * trip
    return d.groupBy("tier", "mult").agg(F.lit(trip).alias("round_trip"), F.avg(net).alias("net"), S.profit_factor(net).alias("pf"))


_NULL = lambda r, o: f"""SELECT {o} AS observed, avg(nm) AS null_average, 100.0 * avg(CASE WHEN nm < {o} THEN 1.0 ELSE 0 END) AS percentile, (1.0 + sum(CASE WHEN abs(nm) >= abs({o}) THEN 1 ELSE 0 END)) / (1.0 + count(*)) AS p FROM {r}"""


@query("placebo_side_flip", "N26", f"""WITH {_EP}, r AS (SELECT unnest(range(50)) AS rep), nul AS (SELECT rep, avg(CASE WHEN {_DRAW("'7'", 'rep', 'symbol', 'ep')} % 2 = 0 THEN m ELSE -m END) AS nm FROM e CROSS JOIN r GROUP BY rep)
""" + _NULL("nul", "(SELECT avg(m) FROM e)"), "observed null_average percentile p")
def placebo_side_flip(spark, folder):
    e = episodes(spark, folder).groupBy("symbol", "ep").agg(F.avg("gross_bps").alias("m"))
    null = S.sign_flip_null(e, [], ["symbol", "ep"], "m", 50, 7)
    return S.null_summary(null, e.agg(F.avg("m").alias("m")), [], "m")


@query("placebo_time_shuffle", "N27 N29", f"""WITH {DECISIONS}, p AS (SELECT symbol, gross_bps AS f, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, id) - 1 AS rn FROM decisions), z AS (SELECT symbol, count(*) AS size FROM p GROUP BY 1), r AS (SELECT unnest(range(8)) AS rep),
dd AS (SELECT rep, side, d.symbol, {_DRAW("'11'", 'rep', 'id')} % size AS rn FROM decisions d JOIN z ON z.symbol = d.symbol CROSS JOIN r), nul AS (SELECT rep, avg(p.f * side) AS nm FROM dd JOIN p ON p.symbol = dd.symbol AND p.rn = dd.rn GROUP BY rep)
""" + _NULL("nul", "(SELECT avg(gross_bps * side) FROM decisions)"), "observed null_average percentile p")
def placebo_time_shuffle(spark, folder):
    d = decisions(spark, folder)
    null = S.pool_draw_null(d, d, ["symbol"], "id", ["ts_us", "id"], "gross_bps", "side", 8, 11, 1000 * DAY_US)
    return S.null_summary(null, d.agg(F.avg(F.col("gross_bps") * F.col("side")).alias("m")), [], "m")


@query("placebo_symbol_shuffle", "N28", f"""WITH {DECISIONS}, p AS (SELECT ts_us, gross_bps AS f, row_number() OVER (PARTITION BY ts_us ORDER BY id) - 1 AS rn FROM decisions), z AS (SELECT ts_us, count(*) AS size FROM p GROUP BY 1), r AS (SELECT unnest(range(8)) AS rep),
dd AS (SELECT rep, side, d.ts_us, {_DRAW("'13'", 'rep', 'id')} % size AS rn FROM decisions d JOIN z ON z.ts_us = d.ts_us CROSS JOIN r), nul AS (SELECT rep, avg(p.f * side) AS nm FROM dd JOIN p ON p.ts_us = dd.ts_us AND p.rn = dd.rn GROUP BY rep)
""" + _NULL("nul", "(SELECT avg(gross_bps * side) FROM decisions)"), "observed null_average percentile p")
def placebo_symbol_shuffle(spark, folder):
    d = decisions(spark, folder)
    null = S.pool_draw_null(d, d, ["ts_us"], "id", ["id"], "gross_bps", "side", 8, 13, 100_000)
    return S.null_summary(null, d.agg(F.avg(F.col("gross_bps") * F.col("side")).alias("m")), [], "m")


@query("global_spearman", "N1 N12", f"""WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b,
 rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS c FROM lineitem), r AS (SELECT corr(a, b) AS xy, corr(a, c) AS xz, corr(b, c) AS yz, count(*) AS n FROM k)
SELECT n, xy AS ic, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS partial_ic FROM r""", "ic partial_ic")
def global_spearman(spark, folder):
    return partial_rank_correlation(read(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")


_FEAT = f"""{_RET}, y AS (SELECT symbol, bar, i, r, volume, lead(r, 1) OVER {_ORD} AS f1, lead(r, 4) OVER {_ORD} AS f4, lag(r) OVER {_ORD} AS past, lead(volume, 1) OVER {_ORD} AS nv FROM x)"""
_RK = lambda x, by: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def _features(spark, folder):
    s = ret_bars(spark, folder, 2, 4)
    return s.add({"f1": R.lag(s, "r", -1), "f4": R.lag(s, "r", -4), "past": R.lag(s, "r"), "nv": R.lag(s, "volume", -1)}).result("symbol", "bar", "r", "volume", "f1", "f4", "past", "nv")


@query("ic_decay", "N2 N9 N14", f"""WITH {_FEAT}, u AS (SELECT symbol, 'f1' AS horizon, volume AS v, f1 AS t, past FROM y UNION ALL SELECT symbol, 'f4', volume, f4, past FROM y), k AS (SELECT symbol, horizon, past, {_RK('v', 'symbol, horizon')} AS a, {_RK('t', 'symbol, horizon')} AS b FROM u WHERE t IS NOT NULL),
k2 AS (SELECT symbol, horizon, CASE WHEN past > 0 THEN 'up' ELSE 'down' END AS regime, v, t FROM u WHERE t IS NOT NULL AND past IS NOT NULL), k3 AS (SELECT symbol, horizon, regime, {_RK('v', 'symbol, horizon, regime')} AS a, {_RK('t', 'symbol, horizon, regime')} AS b FROM k2)
SELECT symbol, horizon, 'all' AS regime, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY 1, 2 UNION ALL SELECT symbol, horizon, regime, count(*), corr(a, b) FROM k3 GROUP BY 1, 2, 3""", "ic")
def ic_decay(spark, folder):
    d = _features(spark, folder).withColumn("v", F.col("volume"))
    u = d.select("symbol", "v", "past", "f1", "f4").unpivot(["symbol", "v", "past"], ["f1", "f4"], "horizon", "t")
    both = u.withColumn("regime", F.lit("all")).unionByName(
        u.where("past is not null").withColumn("regime", F.when(F.col("past") > 0, "up").otherwise("down")))
    return spearman(both, ["symbol", "horizon", "regime"], "v", "t")


@query("reverse_causality", "N3 N72", f"""WITH {_FEAT} SELECT symbol, corr(volume, f1) AS forward_corr, corr(r, nv) AS reverse_corr, count(*) AS n FROM y WHERE f1 IS NOT NULL AND r IS NOT NULL GROUP BY symbol""", "forward_corr reverse_corr")
def reverse_causality(spark, folder):
    d = _features(spark, folder).where("f1 is not null and r is not null")
    return d.groupBy("symbol").agg(F.corr("volume", "f1").alias("forward_corr"), F.corr("r", "nv").alias("reverse_corr"), F.count(F.lit(1)).alias("n"))


@query("effective_sample_size", "N4 N5", f"""WITH {_RET}, l AS (SELECT symbol, close, lag(close, 1) OVER {_ORD} AS l1, lag(close, 2) OVER {_ORD} AS l2, lag(close, 3) OVER {_ORD} AS l3 FROM x), c AS (SELECT symbol, count(*) AS n, corr(close, l1) AS r1, corr(close, l2) AS r2, corr(close, l3) AS r3 FROM l GROUP BY 1)
SELECT symbol, n, n / (1 + 2 * CASE WHEN r1 > 0 THEN r1 + CASE WHEN r2 > 0 THEN r2 + CASE WHEN r3 > 0 THEN r3 ELSE 0 END ELSE 0 END ELSE 0 END) AS ess FROM c""", "ess")
def effective_sample_size(spark, folder):
    return S.effective_sample_size(bars(spark, folder), ["symbol"], ["bar"], "close", 3)


@query("block_permutation", "N6 N7 N54")
def block_permutation(spark, folder):
    d = _features(spark, folder).where("f1 is not null").select("symbol", "bar", "volume", "f1")
    d = number_rows(d, ["symbol"], ["bar"], 60 * DAY_US).withColumnRenamed(RN, "i")
    d = d.withColumns({"a": average_rank("volume", "symbol"), "b": average_rank("f1", "symbol")})
    # Blocks of 24 bars trade places: block k of replicate j takes the targets of the block its digest order names.
    blocks = d.select("symbol", F.floor(F.col("i") / 24).alias("k")).distinct()
    r = S.replicates(blocks, 20)
    w = Window.partitionBy("symbol", "rep")
    r = r.withColumn("place", F.row_number().over(w.orderBy(draw(17, "rep", "symbol", "k"), "k")) - 1)
    x = d.select("symbol", F.floor(F.col("i") / 24).alias("place"), (F.col("i") % 24).alias("o"), "a")
    y = d.select("symbol", F.floor(F.col("i") / 24).alias("k"), (F.col("i") % 24).alias("o"), "b")
    p = r.join(y, ["symbol", "k"]).join(x, ["symbol", "place", "o"]).groupBy("symbol", "rep").agg(F.corr("a", "b").alias("null_mean"))
    return S.null_summary(p, d.groupBy("symbol").agg(F.corr("a", "b").alias("ic")), ["symbol"], "ic")


@query("bh_qvalues", "N8", """WITH p AS (SELECT o_orderkey AS id, (o_totalprice % 1000) / 1000 AS p FROM orders), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p)
SELECT id, p, least(min(p * m / k) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM r""", "p q")
def bh_qvalues(spark, folder):
    d = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_totalprice") % 1000) / 1000).alias("p"))
    return S.bh_qvalues(d, "p", "q")


@query("thirds_and_deciles", "N13 N15 N16 N44", f"""WITH {_FEAT}, z AS (SELECT symbol, volume, f1, ntile(3) OVER {_ORD} AS third FROM y WHERE f1 IS NOT NULL), q AS (SELECT symbol, quantile_cont(volume, 0.1) AS p10, quantile_cont(volume, 0.9) AS p90 FROM z GROUP BY 1)
SELECT z.symbol, avg(f1) FILTER (volume <= p10) AS low_mean, avg(f1) FILTER (volume >= p90) AS high_mean, corr(volume, f1) FILTER (third = 1) AS c1, corr(volume, f1) FILTER (third = 2) AS c2, corr(volume, f1) FILTER (third = 3) AS c3 FROM z JOIN q ON q.symbol = z.symbol GROUP BY z.symbol""", "low_mean high_mean c1 c2 c3")
def thirds_and_deciles(spark, folder):
    d = _features(spark, folder).where("f1 is not null").select("symbol", "bar", "volume", "f1")
    n = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    d = number_rows(d, ["symbol"], ["bar"], 60 * DAY_US).join(n, "symbol")
    # Thirds as equal as can be, the first ones longer.
    big, small = F.floor(F.col("n") / 3) + 1, F.floor(F.col("n") / 3)
    edge = (F.col("n") % 3) * big
    third = F.when(F.col(RN) < edge, F.floor(F.col(RN) / big)).otherwise(F.col("n") % 3 + F.floor((F.col(RN) - edge) / small))
    q = exact_quantiles(d, ["symbol"], "volume", {"p10": 0.1, "p90": 0.9})
    d = d.withColumn("third", third).join(q, "symbol")
    cut = lambda k: F.corr(F.when(F.col("third") == k, F.col("volume")), F.when(F.col("third") == k, F.col("f1")))
    return d.groupBy("symbol").agg(F.avg(F.when(F.col("volume") <= F.col("p10"), F.col("f1"))).alias("low_mean"), F.avg(F.when(F.col("volume") >= F.col("p90"), F.col("f1"))).alias("high_mean"),
                                   cut(0).alias("c1"), cut(1).alias("c2"), cut(2).alias("c3"))


@query("multiplicity_thresholds", "N32 N33 N34", None)
def multiplicity_thresholds(spark, folder):
    d = decisions(spark, folder)
    n = d.groupBy("tier").agg(F.countDistinct("symbol", "year").cast("double").alias("n_trials"), S.t_stat(F.col("gross_bps")).alias("t"))
    return n.select("tier", "n_trials", "t", S.bonferroni_t(F.col("n_trials")).alias("threshold"), S.expected_max_t(F.col("n_trials")).alias("expected_max"),
                    (F.col("t") - S.bonferroni_t(F.col("n_trials"))).alias("margin"))


@query("probabilistic_sharpe", "N35 N36")
def probabilistic_sharpe(spark, folder):
    d = decisions(spark, folder)
    trials = S.probabilistic_sharpe(d, ["symbol"], "gross_bps")
    # the best Sharpe that so many trials show by chance: one row, taken before the second pass
    t = trials.agg(F.count("sharpe").alias("n"), F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("sd")).first()
    mark = F.lit(float(t.mean or 0.0)) + F.lit(float(t.sd or 0.0)) * S.expected_max_t(F.lit(float(t.n))) if t.n > 1 else F.lit(0.0)
    deflated = S.probabilistic_sharpe(d, ["symbol"], "gross_bps", mark).select("symbol", F.col("psr").alias("dsr"))
    return trials.select("symbol", "n", "sharpe", "psr", mark.alias("benchmark")).join(deflated, "symbol")


@query("cscv_overfitting", "N37 N38", f"""WITH {DECISIONS}, u AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts_us // {DAY_US} AS day FROM decisions)), g AS (SELECT day, CASE WHEN i < n % 8 * (n // 8 + 1) THEN i // (n // 8 + 1) ELSE n % 8 + (i - n % 8 * (n // 8 + 1)) // greatest(n // 8, 1) END AS b FROM u),
m AS (SELECT symbol, b, count(*) AS n, sum(gross_bps) AS s, sum(gross_bps * gross_bps) AS q FROM decisions JOIN g ON g.day = ts_us // {DAY_US} GROUP BY 1, 2), k AS (SELECT i AS split FROM range(256) t(i) WHERE bit_count(i::INTEGER) = 4),
d AS (SELECT split, symbol, (split >> b) & 1 AS tr, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM k CROSS JOIN m GROUP BY 1, 2, 3), sr AS (SELECT split, symbol, tr, (s / n) / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0) AS sr FROM d),
w AS (SELECT split, symbol, max(sr) FILTER (tr = 1) AS tr, max(sr) FILTER (tr = 0) AS te FROM sr GROUP BY 1, 2), bst AS (SELECT split, arg_max(te, (tr, symbol)) AS sel FROM w GROUP BY 1),
rk AS (SELECT w.split, sum(CASE WHEN te <= sel THEN 1 ELSE 0 END) / (count(te) + 1.0) AS rank FROM w JOIN bst ON bst.split = w.split WHERE te IS NOT NULL GROUP BY 1) SELECT count(*) AS n_splits, avg(CASE WHEN rank <= 0.5 THEN 1.0 ELSE 0 END) AS pbo FROM rk""", "pbo")
def cscv_overfitting(spark, folder):
    d = decisions(spark, folder).withColumn("day", F.floor(F.col("ts_us") / DAY_US))
    days = number_rows(d.select("day").distinct().withColumn("g", F.lit(0)), ["g"], ["day"], 10_000)
    whole, larger = divmod(days.count(), 8)  # contiguous blocks; the first ones hold a day more
    edge, i = larger * (whole + 1), F.col(RN)
    block = F.when(i < edge, F.floor(i / (whole + 1))).otherwise(larger + F.floor((i - edge) / max(whole, 1)))
    return S.cscv(d.join(days.select("day", block.alias("b")), "day"), "symbol", "b", "gross_bps", 8)


@query("purged_folds", "N39 N40", f"""WITH {PANEL}, u AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM panel)), f AS (SELECT unnest(range(4)) AS fold), b AS (SELECT DISTINCT fold, n // 5 * (fold + 1) AS t0, n // 5 * (fold + 2) AS t1 FROM u CROSS JOIN f)
SELECT fold, count(*) FILTER (i < t0 - 30) AS n_train, count(*) FILTER (i >= t0 AND i < t1) AS n_test, min(day) FILTER (i >= t0 AND i < t1) AS test_from, max(day) FILTER (i < t0 - 30) AS train_to FROM u CROSS JOIN b GROUP BY fold""")
def purged_folds(spark, folder):
    u = number_rows(panel(spark, folder).select("day").distinct().withColumn("g", F.lit(0)), ["g"], ["day"], 10_000)
    n = u.count()
    size = n // 5
    edges = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(size * (k + 1)).alias("t0"), F.lit(size * (k + 2)).alias("t1")) for k in range(4)])
    d = u.withColumn("f", F.explode(edges)).select("day", RN, "f.*")
    i = F.col(RN)
    test, train = (i >= F.col("t0")) & (i < F.col("t1")), i < F.col("t0") - 30
    return d.groupBy("fold").agg(F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(test, 1)).alias("n_test"),
                                 F.min(F.when(test, F.col("day"))).alias("test_from"), F.max(F.when(train, F.col("day"))).alias("train_to"))


@query("balanced_sample", "N42", f"""WITH {DECISIONS}, g AS (SELECT count(DISTINCT (symbol, year)) AS n FROM decisions), r AS (SELECT id, symbol, year, row_number() OVER (PARTITION BY symbol, year ORDER BY {_DRAW("'5'", 'id')}, id) AS p FROM decisions)
SELECT id, symbol, year FROM r, g WHERE p <= greatest(1, 3000 // n)""")
def balanced_sample(spark, folder):
    return S.balanced_sample(decisions(spark, folder), ["symbol", "year"], "id", 3000, 5).select("id", "symbol", "year")


_DAILY = f"{DECISIONS}, dy AS (SELECT symbol, ts_us // {DAY_US} AS day, avg(gross_bps) AS p FROM decisions GROUP BY 1, 2)"


def daily(spark, folder):
    return decisions(spark, folder).groupBy("symbol", F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(F.avg("gross_bps").alias("p"))


@query("newey_west_t", "N43", f"""WITH {_DAILY}, c AS (SELECT symbol, day, p - avg(p) OVER (PARTITION BY symbol) AS e, avg(p) OVER (PARTITION BY symbol) AS mu FROM dy), l AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, count(*) AS n, max(mu) / sqrt((sum(e * e) + 2 * 0.75 * sum(e * e1) + 2 * 0.5 * sum(e * e2) + 2 * 0.25 * sum(e * e3)) / count(*) / count(*)) AS t FROM l GROUP BY symbol""", "t")
def newey_west_t(spark, folder):
    return S.newey_west(daily(spark, folder), ["symbol"], ["day"], "p", 3)


@query("spearman_matrix", "N47 N69", f"""WITH {_MKT}, v AS (SELECT day, symbol, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2.0 AS k FROM x WHERE r IS NOT NULL)
SELECT a.symbol AS a, b.symbol AS b, corr(a.k, b.k) AS r FROM v a JOIN v b ON a.day = b.day GROUP BY 1, 2 HAVING count(*) >= 2""", "r")
def spearman_matrix(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r")
    return S.spearman_pairs(d, "day", "symbol", "r").where("r is not null")


@query("effective_tests", "N45 N46 N47 N69")
def effective_tests(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r").where("r is not null")
    pairs = pin(S.spearman_pairs(d, "day", "symbol", "r"))
    part, li_ji = S.effective_tests(pairs)
    n = F.sqrt(F.count(F.lit(1)).cast("double"))
    return pairs.agg(n.alias("n_series"), F.lit(part).alias("participation"), F.lit(li_ji).alias("li_ji"), (n * n / F.sum(F.col("r") * F.col("r"))).alias("effective_bets"),
                     F.avg(F.when(F.col("a") != F.col("b"), F.abs("r"))).alias("mean_abs_corr"))


_ZC = f"""{_MKT}, nm AS (SELECT DISTINCT symbol FROM x), dys AS (SELECT DISTINCT day FROM x WHERE r IS NOT NULL), f AS (SELECT dys.day, nm.symbol, coalesce(x.r, 0) AS r FROM dys CROSS JOIN nm LEFT JOIN x ON x.day = dys.day AND x.symbol = nm.symbol),
pr AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS r FROM f a JOIN f b ON a.day = b.day GROUP BY 1, 2)"""


@query("correlation_matrix", "N48", f"WITH {_ZC} SELECT a, b, r FROM pr", "r")
def correlation_matrix(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r").where("r is not null")
    return S.correlation_pairs(d, "day", "symbol", "r")


@query("correlation_clusters", "N48", f"""WITH RECURSIVE {_ZC}, g AS (SELECT a, b FROM pr WHERE abs(r) >= 0.03 AND a <> b), c AS (SELECT symbol AS node, symbol AS reach FROM nm UNION SELECT c.node, g.b FROM c JOIN g ON g.a = c.reach) SELECT node, min(reach) AS label FROM c GROUP BY node""")
def correlation_clusters(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r").where("r is not null")
    pairs = S.correlation_pairs(d, "day", "symbol", "r")
    return S.components(pairs.where((F.abs("r") >= 0.03) & (F.col("a") != F.col("b"))), pairs.select(F.col("a").alias("node")).distinct())


_BOOT = lambda block: f"""WITH {_DAILY}, p AS (SELECT symbol, ln(1 + p / 10000) AS l, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS rn FROM dy), z AS (SELECT symbol, count(*) AS size FROM p GROUP BY 1), r AS (SELECT unnest(range(40)) AS rep),
dd AS (SELECT symbol, rep, size, unnest(range(CAST(ceil(size / {block}.0) AS BIGINT))) AS dno FROM z CROSS JOIN r), st AS (SELECT *, {_DRAW("'3'", 'rep', 'symbol', 'dno')} % greatest(size - {block} + 1, 1) AS st FROM dd), ix AS (SELECT symbol, rep, size, dno, st, unnest(range({block})) AS o FROM st),
b AS (SELECT ix.symbol, rep, exp(sum(l) * 365.0 / max(size)) - 1 AS a FROM ix JOIN p ON p.symbol = ix.symbol AND p.rn = st + o WHERE dno * {block} + o < size GROUP BY 1, 2) SELECT symbol, quantile_cont(a, 0.05) AS lcb FROM b GROUP BY symbol"""


@query("bootstrap_lower_bound", "N49", _BOOT(1), "lcb")
def bootstrap_lower_bound(spark, folder):
    d = daily(spark, folder).withColumn("ret", F.col("p") / 10_000)
    return S.bootstrap_lower(d, ["symbol"], ["day"], "ret", 40, 3, 10_000)


@query("block_bootstrap_lower_bound", "N50", _BOOT(5), "lcb")
def block_bootstrap_lower_bound(spark, folder):
    d = daily(spark, folder).withColumn("ret", F.col("p") / 10_000)
    return S.bootstrap_lower(d, ["symbol"], ["day"], "ret", 40, 3, 10_000, block=5)


@query("drop_top_events", "N51", f"WITH {DECISIONS}, r AS (SELECT symbol, gross_bps, row_number() OVER (PARTITION BY symbol ORDER BY gross_bps DESC, id) AS k FROM decisions) SELECT symbol, sum(gross_bps) AS total, sum(CASE WHEN k > 5 THEN gross_bps ELSE 0 END) AS total_without_best FROM r GROUP BY symbol", "total total_without_best", digits=4)
def drop_top_events(spark, folder):
    d = decisions(spark, folder)
    w = Window.partitionBy("symbol").orderBy(F.col("gross_bps").desc(), "id")
    top = d.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("symbol").agg(F.sum("gross_bps").alias("best"))
    t = d.groupBy("symbol").agg(F.sum("gross_bps").alias("total")).join(top, "symbol")
    return t.select("symbol", "total", (F.col("total") - F.col("best")).alias("total_without_best"))


@query("cluster_robust", "N53", f"""WITH {_EP}, o AS (SELECT tier, ep, sum(gross_bps) AS s, count(*) AS n FROM d GROUP BY 1, 2), m AS (SELECT tier, avg(gross_bps) AS mu, count(*) AS nn, coalesce(max(gross_bps) FILTER (gross_bps > 0) / sum(gross_bps) FILTER (gross_bps > 0), 0) AS top1 FROM d GROUP BY 1)
SELECT o.tier, max(mu) AS mean, sqrt(sum(power(s - n * mu, 2))) / max(nn) AS se, max(mu) / (sqrt(sum(power(s - n * mu, 2))) / max(nn)) AS t, max(top1) AS top1_share, count(*) AS n_clusters FROM o JOIN m ON m.tier = o.tier GROUP BY o.tier""", "mean se t top1_share")
def cluster_robust(spark, folder):
    e, gain = episodes(spark, folder), F.when(F.col("gross_bps") > 0, F.col("gross_bps"))
    o = e.groupBy("tier", "ep").agg(F.sum("gross_bps").alias("s"), F.count(F.lit(1)).alias("n"))
    m = e.groupBy("tier").agg(F.avg("gross_bps").alias("mu"), F.count(F.lit(1)).alias("nn"), F.coalesce(F.max(gain) / F.sum(gain), F.lit(0.0)).alias("top1"))
    d = o.join(m, "tier")
    se = F.sqrt(F.sum(F.pow(F.col("s") - F.col("n") * F.col("mu"), 2))) / F.max("nn")
    return d.groupBy("tier").agg(F.max("mu").alias("mean"), se.alias("se"), (F.max("mu") / se).alias("t"), F.max("top1").alias("top1_share"), F.count(F.lit(1)).alias("n_clusters"))


@query("return_concentration", "N55", """WITH d AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders), k AS (SELECT x, sum(x) OVER w AS cum, row_number() OVER w AS i, sum(x) OVER () AS tot, count(*) OVER () AS n FROM d WINDOW w AS (ORDER BY -round(x * 1e6), x, id ROWS UNBOUNDED PRECEDING))
SELECT max(n) AS n, sum(x) * sum(x) / sum(x * x) AS n_eff, min(i) FILTER (cum >= 0.5 * tot) AS rows_50, min(i) FILTER (cum >= 0.9 * tot) AS rows_90, sum(x) FILTER (i <= round(0.01 * n)) / max(tot) AS top_1pct, sum(x) FILTER (i <= round(0.05 * n)) / max(tot) AS top_5pct FROM k""", "n_eff top_1pct top_5pct", digits=5)
def return_concentration(spark, folder):
    d = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    return S.concentration(d, ["x", "id"], "x", 10_000_000_000)


@query("monotonicity_screen", "N57", f"""WITH {_MKT}, q AS (SELECT day, fund, r, ntile(5) OVER (PARTITION BY day ORDER BY fund, symbol) AS b FROM x WHERE r IS NOT NULL), g AS (SELECT b, avg(r) AS m, count(*) AS n FROM q GROUP BY 1) SELECT b, m, n, m > lag(m) OVER (ORDER BY b) AS rising FROM g""", "m")
def monotonicity_screen(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "fund", "r").where("r is not null")
    d = d.withColumn("b", F.ntile(5).over(Window.partitionBy("day").orderBy("fund", "symbol")))
    g = d.groupBy("b").agg(F.avg("r").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("rising", F.col("m") > F.lag("m").over(Window.partitionBy().orderBy("b")))  # five rows


_SC = "sc AS (SELECT d.doc_id, (d.n_chars % 997) / 997.0 AS p, l.quality AS y, (d.n_chars % 13) - 6 AS ret FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def scores(spark, folder):
    d = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    return d.select("doc_id", ((F.col("n_chars") % 997) / 997.0).alias("p"), F.col("quality").alias("y"), (F.col("n_chars") % 13 - 6).alias("ret"))


@query("precision_at_k", "N62", f"""WITH {_SC}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) AS k, count(*) OVER () AS n FROM sc), c AS (SELECT unnest([1, 5, 10, 20]) AS pct)
SELECT pct, count(*) AS picked, avg(y) AS "precision", avg(ret) AS expectancy FROM r CROSS JOIN c WHERE k <= greatest(1, n * pct // 100) GROUP BY pct""", '"precision" expectancy')
def precision_at_k(spark, folder):
    d = scores(spark, folder).withColumns({"g": F.lit(0), "o": (-F.round(F.col("p") * 1e9)).cast("bigint")})
    n = d.count()
    d = number_rows(d, ["g"], ["o", "doc_id"], 100_000_000)
    d = d.withColumn("pct", F.explode(F.array(*[F.lit(x) for x in (1, 5, 10, 20)])))
    d = d.where(F.col(RN) < F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("pct") / 100)))
    return d.groupBy("pct").agg(F.count(F.lit(1)).alias("picked"), F.avg("y").alias("precision"), F.avg("ret").alias("expectancy"))


@query("calibration_error", "N63", f"WITH {_SC}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS freq FROM sc GROUP BY 1) SELECT sum(n * abs(conf - freq)) / sum(n) AS ece, count(*) AS bins FROM b", "ece")
def calibration_error(spark, folder):
    b = scores(spark, folder).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("freq"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("freq"))) / F.sum("n")).alias("ece"), F.count(F.lit(1)).alias("bins"))


@query("threshold_sweep", "N64", f"WITH {_SC}, t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS th) SELECT th, count(*) FILTER (p >= th) AS n, coalesce(sum(ret - 0.1) FILTER (p >= th), 0) AS pnl FROM sc CROSS JOIN t GROUP BY th", "th pnl")
def threshold_sweep(spark, folder):
    d = scores(spark, folder).withColumn("th", F.explode(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7, 0.9)])))
    ok = F.col("p") >= F.col("th")
    return d.groupBy("th").agg(F.count(F.when(ok, 1)).alias("n"), F.sum(ind(ok, F.col("ret") - 0.1)).alias("pnl"))


@query("rolling_selection", "N65", f"""WITH {_DAILY} SELECT symbol, day, p, CASE WHEN count(p) OVER w >= 10 THEN greatest(quantile_cont(p, 0.8) OVER w, 0, 20) END AS threshold, CASE WHEN count(p) OVER w >= 10 THEN p > 0 AND p >= greatest(quantile_cont(p, 0.8) OVER w, 0, 20) END AS kept
 FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING)""", "p threshold")
def rolling_selection(spark, folder):
    # One row per symbol and day, so a 180-day frame holds at most 180 rows.
    s = sequence(daily(spark, folder), ["symbol"], ["day"], back=180, bound=DAYS)
    w = s.by().rangeBetween(-180, -1)
    s = s.add({"threshold": F.when(F.count("p").over(w) >= 10, F.greatest(F.percentile("p", F.lit(0.8)).over(w), F.lit(20.0)))})
    return s.result("symbol", "day", "p", "threshold", F.when(F.col("threshold").isNotNull(), (F.col("p") > 0) & (F.col("p") >= F.col("threshold"))).alias("kept"))


@query("equity_metrics", "N66 O21", f"""WITH {_DAILY}, q AS (SELECT symbol, day, p / 10000 AS r, exp(sum(ln(1 + p / 10000)) OVER (PARTITION BY symbol ORDER BY day)) AS eq FROM dy), k AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY day), 1) AS pk FROM q)
SELECT symbol, power(arg_max(eq, day), 365.0 / (max(day) - min(day))) - 1 AS cagr, avg(r) / stddev_samp(r) * sqrt(365) AS sharpe, avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(365) AS sortino, min(eq / pk - 1) AS max_drawdown FROM k GROUP BY symbol""", "cagr sharpe sortino max_drawdown")
def equity_metrics(spark, folder):
    d = daily(spark, folder).withColumn("r", F.col("p") / 10_000)
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    d = d.withColumn("eq", F.exp(F.sum(F.ln(1 + F.col("r"))).over(w)))
    d = d.withColumn("dd", F.col("eq") / F.greatest(F.max("eq").over(w), F.lit(1.0)) - 1)
    year = math.sqrt(365)
    return d.groupBy("symbol").agg((F.pow(F.max_by("eq", "day"), 365.0 / (F.max("day") - F.min("day"))) - 1).alias("cagr"), (F.avg("r") / F.stddev_samp("r") * year).alias("sharpe"),
                                   (F.avg("r") / F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * year).alias("sortino"), F.min("dd").alias("max_drawdown"))


@query("value_at_risk", "N68", f"""WITH {_DAILY}, l AS (SELECT symbol, p, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM dy), v AS (SELECT symbol, quantile_cont(p, 0.05) AS q FROM l WHERE k <= 250 GROUP BY 1)
SELECT l.symbol, -max(q) AS var95, -avg(p) FILTER (p <= q) AS cvar95 FROM l JOIN v ON v.symbol = l.symbol WHERE k <= 250 GROUP BY l.symbol""", "var95 cvar95")
def value_at_risk(spark, folder):
    w = Window.partitionBy("symbol").orderBy(F.col("day").desc())
    d = daily(spark, folder).withColumn("k", F.row_number().over(w)).where("k <= 250")  # the operator's own look-back
    q = d.groupBy("symbol").agg(F.percentile("p", F.lit(0.05)).alias("q"))
    return d.join(q, "symbol").groupBy("symbol").agg((-F.max("q")).alias("var95"), (-F.avg(F.when(F.col("p") <= F.col("q"), F.col("p")))).alias("cvar95"))


@query("outlier_distance", "N70")
def outlier_distance(spark, folder):
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation, Summarizer

    e = read(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    v = e.select(array_to_vector("x").alias("v"))
    corr = Correlation.corr(v, "v").first()[0].toArray()
    s = v.select(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s")).select("s.mean", "s.std").first()
    mu, sd = s["mean"].toArray(), s["std"].toArray()
    inv = np.linalg.inv(corr * np.outer(sd, sd) + 1e-3 * np.eye(len(mu)))  # dims x dims
    low = np.linalg.cholesky(inv)
    centred = F.zip_with("x", F.array(*[F.lit(float(m)) for m in mu]), lambda a, b: a - b)
    e = e.withColumn("z", centred)
    w = F.array(*[F.array(*[F.lit(float(x)) for x in low[:, j]]) for j in range(len(mu))])
    dot = lambda row: F.aggregate(F.zip_with("z", row, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    dist = F.sqrt(F.aggregate(F.transform(w, lambda row: F.pow(dot(row), 2)), F.lit(0.0), lambda a, b: a + b))
    d = e.select("vec_id", dist.alias("distance"))
    cut = exact_quantiles(d.withColumn("g", F.lit(0)), ["g"], "distance", {"limit": 0.95}).first()["limit"]
    return d.select("vec_id", "distance", (F.col("distance") > cut).alias("outlier"))


@query("ensemble_disagreement", "N71", "SELECT vec_id, list_stddev_pop(embedding) AS disagreement FROM embeddings", "disagreement")
def ensemble_disagreement(spark, folder):
    # Each component stands for one model's output.
    x = F.transform("embedding", lambda v: v.cast("double"))
    n = F.size("embedding")
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / n
    var = F.aggregate(F.transform(x, lambda v: F.pow(v - mean, 2)), F.lit(0.0), lambda a, b: a + b) / n
    return read(spark, folder, "embeddings").select("vec_id", F.sqrt(var).alias("disagreement"))


@query("support_audit", "N73 N74", f"""WITH {BARS} SELECT symbol, count(*) AS n_rows, count(close) AS present, count(*) FILTER (volume > 100) AS active, count(DISTINCT bar) AS distinct_clocks, count(DISTINCT bar // {DAY_US}) AS event_days FROM bars GROUP BY symbol""")
def support_audit(spark, folder):
    return bars(spark, folder).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("close").alias("present"), F.count(F.when(F.col("volume") > 100, 1)).alias("active"),
        F.countDistinct("bar").alias("distinct_clocks"), F.countDistinct(F.floor(F.col("bar") / DAY_US)).alias("event_days"))


_MO = "sum(n) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(xx) AS xx, sum(xz) AS xz, sum(zz) AS zz, sum(xy) AS xy, sum(zy) AS zy, sum(yy) AS yy"
_CO = "xx / n - (x / n) * (x / n) AS cxx, xz / n - (x / n) * (z / n) AS cxz, zz / n - (z / n) * (z / n) AS czz, xy / n - (x / n) * (y / n) AS cxy, zy / n - (z / n) * (y / n) AS czy, yy / n - (y / n) * (y / n) AS cyy"
RIDGE = 0.1


@query("ridge_walk_forward", "N75", f"""WITH {_FEAT}, w AS (SELECT f1 AS y, r AS x, past AS z, bar // (6 * {DAY_US}) AS seg FROM y WHERE f1 IS NOT NULL AND r IS NOT NULL AND past IS NOT NULL),
m AS (SELECT seg, count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM w GROUP BY 1),
p AS (SELECT k.seg, {_MO.replace('sum(', 'sum(m.')} FROM m k JOIN m ON m.seg < k.seg GROUP BY 1), tr AS (SELECT seg, {_CO} FROM p), te AS (SELECT seg, n, {_CO} FROM m),
b AS (SELECT seg, (cxy * czz * {1 + RIDGE} - cxz * czy) / (cxx * czz * {(1 + RIDGE) ** 2!r} - cxz * cxz) AS b_r, (czy * cxx * {1 + RIDGE} - cxz * cxy) / (cxx * czz * {(1 + RIDGE) ** 2!r} - cxz * cxz) AS b_past FROM tr)
SELECT CAST(te.seg - (SELECT min(seg) FROM m) AS BIGINT) AS fold, te.n AS n_test, b_r, b_past, (b_r * cxy + b_past * czy) / sqrt((b_r * b_r * cxx + 2 * b_r * b_past * cxz + b_past * b_past * czz) * cyy) AS ic FROM te JOIN b ON b.seg = te.seg""", "b_r b_past ic", digits=5)
def ridge_walk_forward(spark, folder):
    d = _features(spark, folder).where("f1 is not null and r is not null and past is not null").select(F.floor(F.col("bar") / (6 * DAY_US)).alias("seg"), F.col("r").alias("x"), F.col("past").alias("z"), F.col("f1").alias("y"))
    return S.ridge_walk_forward(d, RIDGE).select("fold", "n_test", F.col("b_x").alias("b_r"), F.col("b_z").alias("b_past"), "ic")


@query("sleeve_admission", "N77", None)
def sleeve_admission(spark, folder):
    d = market_panel(spark, folder, 0).result("day", "symbol", "r").where("r is not null")
    score = d.groupBy("symbol").agg(div(F.avg("r"), F.stddev_samp("r")).alias("score"))
    pairs = S.spearman_pairs(d, "day", "symbol", "r").where("a <> b").select(F.col("a").alias("symbol"), "b", "r")
    better = pairs.join(score, "symbol").join(score.select(F.col("symbol").alias("b"), F.col("score").alias("score_b")), "b")
    # A sleeve clashes with a better one above the limit; the accepted set is the usual greedy one on k names.
    clash = better.where((F.col("score_b") > F.col("score")) & (F.abs("r") > 0.05)).groupBy("symbol").agg(F.collect_set("b").alias("clashes"))
    ranked = [(r["symbol"], r["score"], set(r["clashes"] or [])) for r in score.join(clash, "symbol", "left").orderBy(F.desc("score")).collect()]
    kept: list[str] = []
    rows = []
    for name, sc, bad in ranked:
        ok = not bad & set(kept)
        kept += [name] if ok else []
        rows.append((name, sc, ok))
    return spark.createDataFrame(rows, "symbol string, score double, admitted boolean")
