"""Operators across names at one instant, and exact ranks over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import c, div
from tidemark.operators.blocks import BLOCK_ROWS
from tidemark.session import pin


def average_rank(x: str | Column, *at: str) -> Column:
    """Rank from 1 with ties sharing their mean place; missing values get none.

    For groups bounded by the number of names (one row per name and instant).
    """
    x = c(x)
    have = x.isNotNull()
    w = Window.partitionBy(*at, have).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*at, x))
    return F.when(have, F.rank().over(w) + (ties - 1) / 2.0)


def centred_rank(x: str | Column, *at: str) -> Column:
    """Average rank over the count of present values, minus one half."""
    n = F.count(c(x)).over(Window.partitionBy(*at))
    return div(average_rank(x, *at), n) - 0.5


def first_rank(x: str | Column, tie: str, *at: str, desc: bool = False) -> Column:
    """Rank from 1, ties in the order of ``tie``; missing values get none."""
    x = c(x)
    key = x.desc() if desc else x.asc()
    w = Window.partitionBy(*at, x.isNotNull()).orderBy(key, tie)
    return F.when(x.isNotNull(), F.row_number().over(w))


def over(at: Sequence[str], agg: Column) -> Column:
    return agg.over(Window.partitionBy(*at))


def neutralise(df: DataFrame, *, at: str, y: str, factors: Sequence[str], out: str, min_names: int = 12,
               min_share: float = 0.8) -> DataFrame:
    """Residual of ``y`` on an intercept and the factors, instant by instant.

    A factor present for fewer than ``min_share`` of the names is left out, else its
    gaps take its mean. One group is one instant's names.
    """
    factors = list(factors)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[y].to_numpy("float64")
        ok = np.isfinite(v)
        res = np.full(len(v), np.nan)
        if ok.sum() >= min_names:
            cols = [np.ones(ok.sum())]
            for f in factors:
                x = pdf[f].to_numpy("float64")[ok]
                fin = np.isfinite(x)
                if fin.mean() >= min_share:
                    cols.append(np.where(fin, x, x[fin].mean()))
            a = np.column_stack(cols)
            res[ok] = v[ok] - a @ np.linalg.lstsq(a, v[ok], rcond=None)[0]
        pdf[out] = res
        return pdf

    got = df.groupBy(at).applyInPandas(run, schema)
    return got.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def neutralise_one(x: str, factor: str, *at: str) -> Column:
    """Residual of x on an intercept and one factor per instant, as a column."""
    w = Window.partitionBy(*at)
    both = c(x).isNotNull() & c(factor).isNotNull()
    xx, ff = F.when(both, c(x)), F.when(both, c(factor))
    b = F.regr_slope(c(x), c(factor)).over(w)
    return xx - F.avg(xx).over(w) - b * (ff - F.avg(ff).over(w))


def orthogonal(x: str, m: str, *at: str) -> Column:
    """x minus its projection on m per instant."""
    w = Window.partitionBy(*at)
    both = c(x).isNotNull() & c(m).isNotNull()
    top = F.sum(F.when(both, c(x) * c(m))).over(w)
    bottom = F.sum(F.when(both, c(m) * c(m))).over(w)
    return c(x) - div(top, bottom) * c(m)


def all_present_least(*xs: Column) -> Column:
    """Smallest of the legs; missing if any leg is."""
    ok = xs[0].isNotNull()
    for x in xs[1:]:
        ok = ok & x.isNotNull()
    return F.when(ok, F.least(*xs))


# --- groups without a size bound ---------------------------------------------------------------

def value_cells(df: DataFrame, keys: Sequence[str], x: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, x, n, cell): distinct values with their counts, cut into even value cells.

    Copies of a value combine before the shuffle. Groups that measure small stay one
    cell. Otherwise the cell edges are approximate quantiles, written once so that every
    later use sees the same edges; the cells only spread the work, results stay exact.
    """
    keys = list(keys)
    d = df.where(c(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    top = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    if top <= rows:
        return d.withColumn("cell", F.lit(0))
    cells = int(max(8, 2 * top // rows))  # a cell holds about half of ``rows``, whatever the size
    cuts = F.percentile_approx(x, F.array(*[F.lit(i / cells) for i in range(1, cells)]), 4 * cells)
    edges = pin(d.groupBy(*keys).agg(cuts.alias("_edges")))
    if keys:
        d = d.join(edges, keys)
    else:  # one row of edges
        d = d.withColumn("_edges", F.array(*[F.lit(float(e)) for e in edges.first()["_edges"]]))
    return d.withColumn("cell", F.size(F.filter("_edges", lambda e: e < c(x)))).drop("_edges")


def distinct_ranks(df: DataFrame, keys: Sequence[str], x: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, x, n, below, total): per distinct value its count, the rows below it and the group's rows."""
    keys = list(keys)
    d = value_cells(df, keys, x, rows)
    tot = d.groupBy(*keys, "cell").agg(F.sum("n").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("cell")
    tot = tot.select(*keys, "cell",
                     F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                     F.sum("_c").over(Window.partitionBy(*keys)).alias("total"))
    d = d.join(tot, [*keys, "cell"])
    w = Window.partitionBy(*keys, "cell").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return d.select(*keys, x, "n", (F.col("_off") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("below"), "total")


def global_rank(df: DataFrame, keys: Sequence[str], x: str, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Average-tie rank inside groups of any size."""
    keys = list(keys)
    r = distinct_ranks(df, keys, x, rows)
    r = r.select(*keys, x, (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(r, [*keys, x], "left").select(*df.columns, out)


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: str, qs: dict[str, float], rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size, one column per entry of ``qs``."""
    keys = list(keys)
    r = distinct_ranks(df, keys, x, rows)
    aggs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        aggs += [F.max(F.when(inside(lo), c(x))).alias(f"_l_{name}"), F.max(F.when(inside(hi), c(x))).alias(f"_h_{name}"),
                 F.max(pos - lo).alias(f"_f_{name}")]
    d = r.groupBy(*keys).agg(*aggs)
    return d.select(*keys, *[(F.col(f"_l_{k}") + F.col(f"_f_{k}") * (F.col(f"_h_{k}") - F.col(f"_l_{k}"))).alias(k) for k in qs])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool = False, min_n: int = 3) -> DataFrame:
    """(keys, n, ic): rank correlation per group; ``bounded`` groups use plain windows."""
    keys = list(keys)
    d = df.where(c(x).isNotNull() & c(y).isNotNull()).select(*keys, x, y)
    if bounded:
        d = d.withColumns({"_rx": average_rank(x, *keys), "_ry": average_rank(y, *keys)})
    else:
        d = global_rank(global_rank(d, keys, x, "_rx"), keys, y, "_ry")
    d = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("ic"))
    return d.withColumn("ic", F.when((F.col("n") >= min_n) & ~F.isnan("ic"), F.col("ic")))


def partial_rank_correlation(df: DataFrame, x: str, y: str, control: str, listed: int = 100_000) -> DataFrame:
    """(n, ic, partial_ic): rank correlation of ``x`` and ``y`` over all rows, and without what ``control`` explains.

    No row meets the ranks of ``y``: rows add up by their value of ``y`` first, and sums meet ranks once a value. The
    ranks of ``x`` and ``control`` are broadcast where they are at most ``listed``. Ranks are taken from their middle, so
    that the sums do not cancel.
    """
    d = df.select(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"), c(control).cast("double").alias("z"))
    mid = (d.count() + 1) / 2.0
    ranks = {k: pin(distinct_ranks(d.select(k), [], k).select(k, (F.col("below") + (F.col("n") + 1) / 2.0 - mid).alias(f"r{k}"))) for k in "xyz"}
    few = lambda r: F.broadcast(r) if r.count() <= listed else r
    d = d.join(few(ranks["x"]), "x").join(few(ranks["z"]), "z")
    product = lambda a, b: F.sum(F.col(f"r{a}") * F.col(f"r{b}"))
    g = d.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("rx").alias("x"), F.sum("rz").alias("z"), *[product(*k).alias(k) for k in ("xx", "zz", "xz")]).join(ranks["y"], "y")
    g = g.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in ("x", "z", "xx", "zz", "xz")], F.sum(F.col("n") * F.col("ry")).alias("y"),
              F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"), F.sum(F.col("x") * F.col("ry")).alias("xy"), F.sum(F.col("z") * F.col("ry")).alias("yz"))
    part = lambda a, b: F.col(a + b) - F.col(a) * F.col(b) / F.col("n")
    corr = lambda a, b: part(a, b) / F.sqrt(part(a, a) * part(b, b))
    xy, xz, yz = corr("x", "y"), corr("x", "z"), corr("y", "z")
    return g.select("n", xy.alias("ic"), ((xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))).alias("partial_ic"))


def lead_lag(df: DataFrame, keys: Sequence[str], at: str, member: str, value: str, members: Sequence, max_lag: int) -> DataFrame:
    """(keys, leader, follower, lag, r): for each ordered pair the lag with the largest absolute correlation.

    ``members`` is a short fixed list (venues); their series stand side by side as columns,
    so no pair of rows is formed.
    """
    from tidemark.operators.blocks import sequence

    keys, members = list(keys), list(members)
    wide = df.groupBy(*keys, at).pivot(member, members).agg(F.first(value))
    s = sequence(wide, keys, [at], back=max_lag)
    s = s.add({f"l{k}_{m}": F.lag(str(m), k).over(s.by()) for m in members for k in range(1, max_lag + 1)})
    pairs = [(a, b, k) for a in members for b in members if a != b for k in range(1, max_lag + 1)]
    corr = [F.corr(f"l{k}_{a}", F.col(str(b))).alias(f"c{i}") for i, (a, b, k) in enumerate(pairs)]
    d = s.result().groupBy(*keys).agg(*corr)
    rows = F.array(*[F.struct(F.lit(a).alias("leader"), F.lit(b).alias("follower"), F.lit(k).alias("lag"), F.col(f"c{i}").alias("r")) for i, (a, b, k) in enumerate(pairs)])
    d = d.select(*keys, F.explode(rows).alias("p")).select(*keys, "p.*").where(F.col("r").isNotNull() & ~F.isnan("r"))
    return d.groupBy(*keys, "leader", "follower").agg(F.max_by("lag", F.struct(F.abs("r"), -F.col("lag"))).alias("lag"), F.max_by("r", F.struct(F.abs("r"), -F.col("lag"))).alias("r"))
