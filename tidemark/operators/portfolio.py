"""Scores to weights to returns on long panels (one row per instant and name)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clip, div, flag
from tidemark.operators.blocks import sequence
from tidemark.operators.crosssection import first_rank


def top_bucket(df: DataFrame, *, at: str, name: str, score: str, liquidity: str, floor: float, fraction: float) -> DataFrame:
    """The best ceil(fraction*n) liquid names of each instant, ties by name."""
    d = df.where((c(liquidity) >= floor) & c(score).isNotNull())
    d = d.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(at)),
                       "place": F.row_number().over(Window.partitionBy(at).orderBy(c(score).desc(), name))})
    return d.where(F.col("place") <= F.ceil(F.col("_n") * fraction)).drop("_n")


def long_short(df: DataFrame, *, at: str, name: str, score: str, liquidity: str, floor: float, fraction: float) -> DataFrame:
    """Both ends of the liquid names, min(ceil(fraction*n), n//2) each, without overlap; ``leg`` is 1 or -1."""
    d = df.where((c(liquidity) >= floor) & c(score).isNotNull())
    d = d.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(at)),
                       "_up": F.row_number().over(Window.partitionBy(at).orderBy(c(score).desc(), name)),
                       "_dn": F.row_number().over(Window.partitionBy(at).orderBy(c(score).asc(), c(name).desc()))})
    k = F.least(F.ceil(F.col("_n") * fraction), F.floor(F.col("_n") / 2))
    leg = F.when(F.col("_up") <= k, 1).when(F.col("_dn") <= k, -1)
    return d.withColumn("leg", leg).where(F.col("leg").isNotNull()).drop("_n", "_up", "_dn")


def targets(df: DataFrame, *, at: str, name: str, score: str, k: int) -> DataFrame:
    """Add ``target``: -1/k for the k lowest, 1/k for the k highest, else 0 (0 everywhere below 2k+2 names)."""
    d = df.withColumns({"_r": first_rank(score, name, at), "_n": F.count(c(score)).over(Window.partitionBy(at))})
    t = F.when(F.col("_n") < 2 * k + 2, 0.0).when(F.col("_r") <= k, -1.0 / k).when(F.col("_r") > F.col("_n") - k, 1.0 / k).otherwise(0.0)
    return d.withColumns({"target": F.when(F.col("_r").isNull(), 0.0).otherwise(t), "ok": F.col("_n") >= 2 * k + 2}).drop("_r", "_n")


def overlapping_returns(df: DataFrame, *, at: str, name: str, ret: str, span: int, lag: int, cost: Column) -> DataFrame:
    """(at, gross_bps, cost_bps, turnover) of portfolios that hold each target for ``span`` instants.

    The weight is the mean of the last ``span`` targets, executed ``lag`` instants later.
    ``df`` needs every name on every instant (a full calendar). The inverse portfolio has
    the opposite gross and the same cost.
    """
    s = sequence(df, [name], [at], back=span + lag + 2)
    s = s.add({"_w": F.avg("target").over(s.rows(-(span - 1), 0))})
    s = s.add({"_e": F.coalesce(F.lag("_w", lag).over(s.by()), F.lit(0.0)) if lag else F.col("_w")})
    s = s.add({"_x": F.when(c(ret).isNotNull(), F.col("_e")).otherwise(0.0)})
    s = s.add({"_d": F.abs(F.col("_x") - F.coalesce(F.lag("_x").over(s.by()), F.lit(0.0)))})
    d = s.result()
    return d.groupBy(at).agg(F.sum(F.col("_x") * F.coalesce(c(ret), F.lit(0.0)) * 1e4).alias("gross_bps"),
                             F.sum(F.col("_d") * cost / 2.0).alias("cost_bps"), F.sum("_d").alias("turnover"))


def capped_weights(df: DataFrame, *, group: Sequence[str], name: str, raw: str, cap: float, out: str) -> DataFrame:
    """Weights proportional to ``raw`` and summing to 1, none above ``cap``.

    Names are capped from the largest down: with j names at the cap the rest share
    1 - j*cap in proportion; the smallest j for which no other name exceeds the cap is
    the answer. Prefix sums per group give it without iterating. Where cap*n < 1 every
    name gets the cap.
    """
    group = list(group)
    w = Window.partitionBy(*group).orderBy(c(raw).desc(), name)
    every = Window.partitionBy(*group)
    d = df.withColumns({"_i": F.row_number().over(w), "_sum": F.sum(raw).over(every), "_n": F.count(F.lit(1)).over(every),
                        "_head": F.sum(raw).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    tail = F.col("_sum") - F.coalesce(F.col("_head"), F.lit(0.0))
    # Share this name would get if exactly the names before it were capped.
    share = c(raw) * (1.0 - (F.col("_i") - 1) * cap) / tail
    d = d.withColumn("_over", (share > cap) | (F.col("_n") * cap < 1.0))
    free = F.min(F.when(~F.col("_over"), F.col("_i"))).over(every)
    d = d.withColumn("_j", F.coalesce(free - 1, F.col("_n")))
    rest = F.sum(F.when(F.col("_i") > F.col("_j"), c(raw))).over(every)
    weight = F.when(F.col("_i") <= F.col("_j"), F.lit(cap)).otherwise(c(raw) * (1.0 - F.col("_j") * cap) / rest)
    return d.withColumn(out, weight).drop("_i", "_sum", "_n", "_head", "_over", "_j")


def liquidity_cost(base: float, adv: Column, median_adv: Column, top: float = 4.0) -> Column:
    """Base cost scaled by sqrt(median/own liquidity) between 1 and ``top``; unknown liquidity pays the top."""
    return F.coalesce(base * clip(F.sqrt(div(median_adv, adv)), 1.0, top), F.lit(base * top))


def net_positions(intents: DataFrame, *, asset: str, fraction: str, cap: float, gross_cap: float) -> DataFrame:
    """Signed intents netted per asset, bounded per asset, scaled so that the sum of sizes fits ``gross_cap``."""
    d = intents.groupBy(asset).agg(F.sum(fraction).alias("net"), F.count(F.lit(1)).alias("n_intents"))
    d = d.withColumn("capped", clip("net", -cap, cap))
    total = d.agg(F.sum(F.abs("capped")).alias("_g")).withColumn("_k", F.lit(1))
    d = d.withColumn("_k", F.lit(1)).join(total, "_k")
    return d.withColumn("final", F.col("capped") * F.least(F.lit(1.0), F.lit(gross_cap) / F.col("_g"))).drop("_k", "_g")


def ledger_chain_breaks(df: DataFrame, *, order: Sequence[str], body: str, chain: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose stored chain is not the digest of the chain before plus their body."""
    s = sequence(df, keys, order, back=1)
    prev = F.coalesce(F.lag(chain).over(s.by()), F.lit(""))
    return s.add({"expected": F.sha2(F.concat(prev, c(body)), 256)}).result().where(c(chain) != F.col("expected"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: Sequence[str], fields: dict[str, float]) -> DataFrame:
    """(key, field, ours, theirs) where the difference exceeds the field's tolerance or one side is missing."""
    key = list(key)
    a = ours.select(*key, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = theirs.select(*key, *[F.col(f).alias(f"b_{f}") for f in fields])
    d = a.join(b, key, "full")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("double").alias("ours"), F.col(f"b_{f}").cast("double").alias("theirs"),
                              F.lit(tol).alias("tol")) for f, tol in fields.items()])
    d = d.select(*key, F.explode(rows).alias("r")).select(*key, "r.*")
    return d.where(F.coalesce(F.abs(F.col("ours") - F.col("theirs")) > F.col("tol"), F.lit(True))).drop("tol")


def crowd_decisions(df: DataFrame, *, at: str, name: str, crowd: str, liquidity: str, ret_bps: str, top: int, every: int, least: int, basket: int) -> DataFrame:
    """(at, name, crowd, side, gross_bps): on every ``every``-th instant the names with the smallest crowd are bought, those with the largest sold.

    ``liquidity`` and ``crowd`` must be known before the instant. Only the ``top`` most liquid names take part; instants
    with fewer than ``least`` of them are left out.
    """
    d = df.where(c(liquidity).isNotNull()).withColumn("_liq", F.row_number().over(Window.partitionBy(at).orderBy(c(liquidity).desc(), name))).where((F.col("_liq") <= top) & c(crowd).isNotNull())
    steps = d.select(at).distinct().withColumn("_step", F.row_number().over(Window.orderBy(at)) - 1)  # one row an instant
    d = d.join(steps.where(F.col("_step") % every == 0).select(at), at)
    d = d.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(at)), "_up": F.row_number().over(Window.partitionBy(at).orderBy(crowd, name)), "_dn": F.row_number().over(Window.partitionBy(at).orderBy(c(crowd).desc(), name))})
    side = F.when(F.col("_up") <= basket, 1).when(F.col("_dn") <= basket, -1)
    return d.where(F.col("_n") >= least).withColumn("side", side).where("side IS NOT NULL").select(at, name, crowd, "side", (F.col("side") * c(ret_bps)).alias("gross_bps"))
