"""Validation statistics: episode metrics, multiplicity, resampling and placebos.

Replicates are rows: data are first combined to episodes or days, each row is then
exploded over the replicate numbers and a digest decides its draw. Results do not
depend on how Spark partitions the work.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, div, draw, erfc, ind, normal_cdf, normal_quantile, uniform
from tidemark.operators.blocks import RN, number_rows, sequence
from tidemark.session import pin

YEAR_US = 365.25 * 86_400 * 1e6


def profit_factor(x: Column) -> Column:
    """Wins over losses as an aggregate; infinite without losses."""
    win, loss = F.sum(ind(x > 0, x)), -F.sum(ind(x < 0, x))
    return F.when(loss > 0, F.try_divide(win, loss)).when(win > 0, F.lit(float("inf"))).otherwise(0.0)


def t_stat(x: Column) -> Column:
    return div(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.count(x))


def episode_means(df: DataFrame, keys: Sequence[str], episode: str, value: str) -> DataFrame:
    return df.groupBy(*keys, episode).agg(F.avg(value).alias("ep_mean"), F.count(F.lit(1)).alias("ep_n"), F.sum(value).alias("ep_sum"))


def metrics(df: DataFrame, keys: Sequence[str], episode: str, gross: str, clock: str, cost: float) -> DataFrame:
    """Episode statistics and trade economics per group of ``keys``, net of ``cost`` bps."""
    keys = list(keys)
    e = episode_means(df, keys, episode, gross)
    x = F.col("ep_mean")
    a = e.groupBy(*keys).agg(
        F.count(x).alias("n_independent"), F.avg(x).alias("gross_edge"), t_stat(x).alias("t_stat"),
        F.stddev_samp(x).alias("sigma"), F.stddev_samp(F.when(x - cost < 0, x - cost)).alias("_down"))
    g = c(gross)
    b = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_raw"), profit_factor(g).alias("pf_gross"), profit_factor(g - cost).alias("pf_net"),
        profit_factor(g - 2 * cost).alias("pf_net_x2"), F.avg(ind(g - cost > 0)).alias("hit_rate"),
        ((F.max(clock) - F.min(clock)) / YEAR_US).alias("_years"))
    d = a.join(b, keys) if keys else a.withColumn("_g", F.lit(0)).join(b.withColumn("_g", F.lit(0)), "_g").drop("_g")
    per_year = F.sqrt(div("n_independent", "_years"))
    net = F.col("gross_edge") - cost
    return d.withColumns({"net_edge": net, "net_edge_x2": F.col("gross_edge") - 2 * cost, "sharpe": div(net, "sigma") * per_year,
                          "sortino": div(net, "_down") * per_year}).drop("_down", "_years")


def without_one(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group the overall mean without it."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy()
    return g.select(group, div(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")).alias("mean_without"))


def bh_qvalues(df: DataFrame, p: str, out: str, rows: int = 200_000) -> DataFrame:
    """Step-up false-discovery values: p*m/rank, then the smallest over larger ranks. Missing stays missing.

    Ranks and the running minimum are taken over value cells, so the table of tests may
    have any length.
    """
    from tidemark.operators.crosssection import value_cells

    cells = value_cells(df, [], p, rows)
    sums = pin(cells.groupBy("cell").agg(F.sum("n").alias("_c")))
    w = Window.partitionBy().orderBy("cell")
    off = sums.select("cell", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                      F.sum("_c").over(Window.partitionBy()).alias("_m"))
    wv = Window.partitionBy("cell").orderBy(p)
    d = cells.join(off, "cell").withColumn("_r", F.col("_off") + F.sum("n").over(wv.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_q", c(p) * F.col("_m") / F.col("_r"))
    tail = d.groupBy("cell").agg(F.min("_q").alias("_t"))
    tail = tail.select("cell", F.min("_t").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    d = d.join(tail, "cell").withColumn("_q", F.least(F.min("_q").over(wv.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"), F.lit(1.0)))
    return df.join(d.select(p, F.col("_q").alias(out)), p, "left").select(*df.columns, out)


def bonferroni_t(n: Column, alpha: float = 0.05) -> Column:
    return normal_quantile(1.0 - F.lit(alpha) / n)


def expected_max_t(n: Column) -> Column:
    """Expected largest of n independent normal statistics."""
    g = 0.5772156649015329
    return (1 - g) * normal_quantile(1 - 1 / n) + g * normal_quantile(1 - 1 / (n * math.e))


def correlation_pvalue(r: Column, ess: Column) -> Column:
    """Two-sided p of a correlation with an effective sample size."""
    z = F.abs(0.5 * F.ln((1 + r) / (1 - r))) * F.sqrt(F.greatest(ess - 3, F.lit(0.0)))
    return erfc(z / math.sqrt(2.0))


def probabilistic_sharpe(df: DataFrame, keys: Sequence[str], x: str, benchmark: Column | None = None) -> DataFrame:
    """(keys, n, sharpe, psr): probability that the true Sharpe exceeds the benchmark, with skew and kurtosis."""
    v = c(x)
    d = df.groupBy(*keys).agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"), F.skewness(v).alias("_k3"), F.kurtosis(v).alias("_k4"))
    shrink = F.sqrt((F.col("n") - 1) / F.col("n"))
    sr = div("_m", "_s")
    skew, kurt = F.col("_k3") * F.pow(shrink, 3), (F.col("_k4") + 3) * F.pow(shrink, 4)
    d = d.withColumns({"sharpe": sr, "_den": F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-18))})
    mark = benchmark if benchmark is not None else F.lit(0.0)
    z = (F.col("sharpe") - mark) * F.sqrt(F.col("n") - 1) / F.sqrt("_den")
    return d.select(*keys, "n", "sharpe", normal_cdf(z).alias("psr"))


def newey_west(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, lags: int) -> DataFrame:
    """(keys, n, t): mean over its autocorrelation-robust standard error (Bartlett weights)."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_mu"))
    d = df.join(mean, keys).withColumn("_e", c(x) - F.col("_mu")) if keys else None
    s = sequence(d, keys, order, back=lags)
    prods = {f"_p{k}": F.col("_e") * F.lag("_e", k).over(s.by()) for k in range(lags + 1)}
    d = s.add(prods).result().groupBy(*keys).agg(F.count("_e").alias("n"), F.first("_mu").alias("_mu"), *[F.sum(p).alias(p) for p in prods])
    var = F.col("_p0") / F.col("n")
    for k in range(1, lags + 1):
        var = var + 2.0 * (1.0 - k / (lags + 1.0)) * F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) / F.col("n")
    return d.select(*keys, "n", (F.try_divide(F.col("_mu"), F.sqrt(F.greatest(var, F.lit(1e-18)) / F.col("n")))).alias("t"))


def effective_sample_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, lags: int) -> DataFrame:
    """(keys, n, ess): n over 1 + 2*sum of autocorrelations before the first that is not positive."""
    keys = list(keys)
    s = sequence(df.where(c(x).isNotNull()), keys, order, back=lags)
    d = s.add({f"_l{k}": F.lag(x, k).over(s.by()) for k in range(1, lags + 1)}).result()
    d = d.groupBy(*keys).agg(F.count(x).alias("n"), F.array(*[F.corr(x, f"_l{k}") for k in range(1, lags + 1)]).alias("_rho"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("on"))

    def step(a, r):
        on = a["on"] & F.coalesce((r > 0) & ~F.isnan(r), F.lit(False))
        return F.struct(F.when(on, a["sum"] + r).otherwise(a["sum"]).alias("sum"), on.alias("on"))

    total = F.aggregate("_rho", start, step, lambda a: a["sum"])
    return d.select(*keys, "n", (F.col("n") / (1.0 + 2.0 * total)).alias("ess"))


# --- replicates ----------------------------------------------------------------------------------

def replicates(df: DataFrame, n: int, out: str = "rep") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sign_flip_null(episodes: DataFrame, keys: Sequence[str], unit: Sequence[str], value: str, n: int, seed: int) -> DataFrame:
    """(keys, rep, null_mean): mean of episode values under random signs."""
    d = replicates(episodes, n)
    sign = F.when(draw(seed, "rep", *unit) % 2 == 0, 1.0).otherwise(-1.0)
    return d.groupBy(*keys, "rep").agg(F.avg(sign * c(value)).alias("null_mean"))


def pool_draw_null(decisions: DataFrame, pool: DataFrame, by: Sequence[str], unit: str, pool_order: Sequence[str], forward: str,
                   side: str, n: int, seed: int, width: int) -> DataFrame:
    """(rep, null_mean): each decision's outcome replaced by a random one of its pool (same symbol, or same instant).

    Pool rows are numbered per key; a draw is an equi-join on (key, number), which is
    spread evenly whatever the size of a key.
    """
    by = list(by)
    p = number_rows(pool.select(*by, *pool_order, F.col(forward).alias("_f")), by, pool_order, width)
    size = p.groupBy(*by).agg((F.max(RN) + 1).alias("_size"))
    d = replicates(decisions.select(*by, unit, side).join(size, by), n)
    d = d.withColumn(RN, F.pmod(draw(seed, "rep", unit), F.col("_size")))
    d = d.join(p.select(*by, RN, "_f"), [*by, RN])
    return d.groupBy("rep").agg(F.avg(F.col("_f") * F.col(side)).alias("null_mean"))


def null_summary(null: DataFrame, observed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, observed, null_average, percentile, p) against the replicate means."""
    keys = list(keys)
    d = null.join(observed, keys) if keys else null.withColumn("_g", F.lit(0)).join(observed.withColumn("_g", F.lit(0)), "_g")
    return d.groupBy(*keys).agg(
        F.first(value).alias("observed"), F.avg("null_mean").alias("null_average"), (100.0 * F.avg(ind(F.col("null_mean") < c(value)))).alias("percentile"),
        ((1.0 + F.sum(ind(F.abs("null_mean") >= F.abs(c(value))))) / (1.0 + F.count(F.lit(1)))).alias("p"))


def bootstrap_indices(sizes: DataFrame, keys: Sequence[str], n: int, seed: int, block: int = 1) -> DataFrame:
    """(keys, rep, _rn): drawn row numbers; ``block`` > 1 draws runs of consecutive rows."""
    keys = list(keys)
    d = replicates(sizes, n)
    starts = F.ceil(F.col("_size") / block)
    d = d.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("bigint"), starts - 1)))
    d = d.withColumn("_s", F.pmod(draw(seed, "rep", *keys, "_d"), F.greatest(F.col("_size") - block + 1, F.lit(1))))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return d.where(F.col("_d") * block + F.col("_o") < F.col("_size")).select(*keys, "rep", (F.col("_s") + F.col("_o")).alias(RN), "_size")


def bootstrap_lower(df: DataFrame, keys: Sequence[str], order: Sequence[str], ret: str, n: int, seed: int, width: int, block: int = 1) -> DataFrame:
    """(keys, lcb): 5th percentile over replicates of the annualised compounded return."""
    keys = list(keys)
    d = number_rows(df.select(*keys, *order, F.ln(1 + c(ret)).alias("_l")), keys, order, width)
    sizes = d.groupBy(*keys).agg((F.max(RN) + 1).alias("_size"))
    idx = bootstrap_indices(sizes, keys, n, seed, block)
    b = idx.join(d.select(*keys, RN, "_l"), [*keys, RN]).groupBy(*keys, "rep").agg((F.exp(F.sum("_l") * 365.0 / F.first("_size")) - 1).alias("_a"))
    return b.groupBy(*keys).agg(F.percentile("_a", F.lit(0.05)).alias("lcb"))


# --- families of strategies -------------------------------------------------------------------------

def cscv(df: DataFrame, strategy: str, block: str, value: str, n_blocks: int) -> DataFrame:
    """One row (n_splits, pbo): share of half-splits whose best training strategy ranks in the lower test half.

    Each strategy enters as its block moments; a split is a bit mask with half the bits set.
    """
    m = df.groupBy(strategy, block).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(c(value) * c(value)).alias("q"))
    masks = df.sparkSession.range(1 << n_blocks).where(F.bit_count("id") == n_blocks // 2).withColumnRenamed("id", "split")
    parts = masks.withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    parts = parts.withColumn("_train", F.shiftright(F.col("split"), 0).bitwiseAND(F.expr(f"shiftleft(1L, cast({block} as int))")) != 0)
    d = parts.join(m, block).groupBy("split", strategy, "_train").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    sd = F.sqrt(F.greatest(div(F.col("q") - div(F.col("s") * F.col("s"), "n"), F.col("n") - 1), F.lit(0.0)))
    d = d.withColumn("sr", div(F.col("s") / F.col("n"), sd))
    d = d.groupBy("split", strategy).agg(F.max(F.when(F.col("_train"), F.col("sr"))).alias("tr"), F.max(F.when(~F.col("_train"), F.col("sr"))).alias("te"))
    best = d.groupBy("split").agg(F.max_by("te", F.struct("tr", strategy)).alias("_sel"))
    d = d.join(best, "split").where(F.col("te").isNotNull() & F.col("_sel").isNotNull())
    d = d.groupBy("split").agg((F.sum(ind(F.col("te") <= F.col("_sel"))) / (F.count("te") + 1.0)).alias("rank"))
    return d.agg(F.count(F.lit(1)).alias("n_splits"), F.avg(ind(F.col("rank") <= 0.5)).alias("pbo"))


def ridge_walk_forward(df: DataFrame, penalty: float, seg: str = "seg", x: str = "x", z: str = "z", y: str = "y") -> DataFrame:
    """(fold, n_test, b_x, b_z, ic): ridge of y on x and z over all earlier segments, scored on each segment.

    The penalty is per row and in units of each regressor's variance. One pass takes the moments of each segment;
    coefficients and correlations follow from them, whatever the number of segments.
    """
    pair = {"xx": (x, x), "xz": (x, z), "zz": (z, z), "xy": (x, y), "zy": (z, y), "yy": (y, y)}
    m = df.groupBy(seg).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in (("x", x), ("z", z), ("y", y))], *[F.sum(c(a) * c(b)).alias(k) for k, (a, b) in pair.items()])
    w = Window.partitionBy().orderBy(seg)  # one row a segment
    sums = ["n", "x", "z", "y", *pair]
    d = m.withColumns({"fold": (F.col(seg) - F.min(seg).over(Window.partitionBy())).cast("bigint"), **{f"t_{k}": F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k in sums}})

    def cov(k: str, p: str) -> Column:
        return F.col(p + k) / F.col(p + "n") - (F.col(p + k[0]) / F.col(p + "n")) * (F.col(p + k[1]) / F.col(p + "n"))

    t = {k: cov(k, "t_") for k in pair}
    e = {k: cov(k, "") for k in pair}
    up = 1 + penalty
    det = t["xx"] * t["zz"] * up ** 2 - t["xz"] * t["xz"]
    bx, bz = div(t["xy"] * t["zz"] * up - t["xz"] * t["zy"], det), div(t["zy"] * t["xx"] * up - t["xz"] * t["xy"], det)
    spread = (bx * bx * e["xx"] + 2 * bx * bz * e["xz"] + bz * bz * e["zz"]) * e["yy"]
    return d.where("fold > 0").select("fold", F.col("n").alias("n_test"), bx.alias("b_x"), bz.alias("b_z"), div(bx * e["xy"] + bz * e["zy"], F.sqrt(spread)).alias("ic"))


def correlation_pairs(df: DataFrame, at: str, name: str, value: str, limit: int = 512) -> DataFrame:
    """(a, b, r) of a bounded family of series: moments of the pivoted rows, one pass.

    The family size is checked; the rows stay distributed and only the k x k moments are
    formed. Missing cells count as 0.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    names = [r[0] for r in df.select(name).distinct().orderBy(name).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} series; correlate a family at a time")
    wide = df.groupBy(at).pivot(name, names).agg(F.first(value)).na.fill(0.0)
    vec = VectorAssembler(inputCols=names, outputCol="_v").transform(wide)
    m = Correlation.corr(vec.select("_v"), "_v").first()[0].toArray()
    rows = [(names[i], names[j], float(m[i, j])) for i in range(len(names)) for j in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def spearman_pairs(df: DataFrame, at: str, name: str, value: str, block: int = 32, least: int = 2) -> DataFrame:
    """(a, b, r): correlation of every two series' own ranks over the clocks both have; gaps stay missing.

    Series are dealt into blocks, and each pair of blocks is a task of its own: the result is k x k, the work is spread
    over (k / block) ** 2 / 2 tasks, and a task holds the clocks of 2 * block series. Fewer than ``least`` common clocks
    give a missing value.
    """
    d = df.where(c(value).isNotNull()).select(c(at).alias("at"), c(name).cast("string").alias("name"), c(value).cast("double").alias("x"))
    k = d.select("name").distinct().count()
    blocks = max(1, -(-k // block))
    own = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def correlate(pdf):
        import pandas as pd

        side = pdf.drop_duplicates("name").set_index("name")["own"]
        m = pdf.pivot_table(index="at", columns="name", values="x", aggfunc="first").rank().corr(min_periods=least)
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = [s for s in m.columns if side[s] == lo], [s for s in m.columns if side[s] == hi]
        out = pd.DataFrame([(a, b, m.at[a, b]) for a in left for b in right], columns=["a", "b", "r"])
        return out if lo == hi else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[["a", "b", "r"]]])

    return d.groupBy("lo", "hi").applyInPandas(correlate, "a string, b string, r double").withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def effective_tests(pairs: DataFrame) -> tuple[float, float]:
    """Participation ratio and Li-Ji count of a correlation table (k x k values)."""
    got = pairs.toPandas().pivot(index="a", columns="b", values="r").to_numpy()
    ev = np.clip(np.linalg.eigvalsh(np.nan_to_num(got)), 0, None)
    li_ji = sum(min(e, 1.0) + (e - math.floor(e) if e >= 1 else 0.0) for e in ev)
    return float(ev.sum() ** 2 / (ev ** 2).sum()), float(min(max(li_ji, 1.0), len(ev)))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): connected components by repeated smallest-label exchange; lineage is cut each round."""
    both = pin(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    lab = pin(nodes.select(F.col("node"), F.col("node").alias("label")))
    while True:  # labels only fall, so this ends
        near = both.join(lab, both["y"] == lab["node"]).groupBy("x").agg(F.min("label").alias("_m")).withColumnRenamed("x", "node")
        new = lab.join(near, "node", "left").select("node", F.least("label", "_m").alias("label"))
        # Follow the label's own label: path lengths halve each round.
        up = new.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        new = pin(new.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label")))
        moved = new.join(lab.withColumnRenamed("label", "_old"), "node").where("label <> _old").limit(1).count()
        lab = new
        if not moved:
            return lab


def concentration(df: DataFrame, order: Sequence[str], x: str, width: int) -> DataFrame:
    """One row: effective count of gains, rows to reach half and 90 percent of the total, share of the top rows."""
    from tidemark.operators.blocks import running_total

    d = df.where(c(x).isNotNull()).select(x, *[o for o in order if o != x]).withColumn("_desc", (-F.round(c(x) * 1e6)).cast("bigint"))
    d = running_total(d, [], ["_desc", *order], {"_cum": c(x), "_i": F.lit(1)}, width)
    t = df.agg(F.sum(x).alias("_tot"), F.count(x).alias("_n")).withColumn("_g", F.lit(0))
    d = d.withColumn("_g", F.lit(0)).join(t, "_g")
    k = lambda q: F.greatest(F.lit(1), F.round(q * F.col("_n")))
    pos = ind(c(x) > 0, c(x))
    return d.agg(F.first("_n").alias("n"), div(F.sum(pos) * F.sum(pos), F.sum(pos * pos)).alias("n_eff"),
                 F.min(F.when(F.col("_cum") >= 0.5 * F.col("_tot"), F.col("_i"))).alias("rows_50"), F.min(F.when(F.col("_cum") >= 0.9 * F.col("_tot"), F.col("_i"))).alias("rows_90"),
                 (F.sum(ind(F.col("_i") <= k(0.01), c(x))) / F.first("_tot")).alias("top_1pct"), (F.sum(ind(F.col("_i") <= k(0.05), c(x))) / F.first("_tot")).alias("top_5pct"))


def robust_failures(**tests: Column) -> Column:
    """Names of the failed tests, as a sorted array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in sorted(tests.items())]))


def balanced_sample(df: DataFrame, groups: Sequence[str], unit: str, max_rows: int, seed: int) -> DataFrame:
    """At most ``max_rows``/groups rows of each group, chosen by a seeded digest."""
    n = df.select(*groups).distinct().count()
    quota = max(1, max_rows // max(n, 1))
    # Digests are even, so they serve as the clock that spreads a large group over blocks.
    d = number_rows(df.withColumn("_d", draw(seed, unit)), groups, ["_d", unit], 1 << 24)
    return d.where(F.col(RN) < quota).drop("_d", RN)
