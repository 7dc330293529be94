"""Bars, flow bars and grouped aggregates. All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, div, floor_to, ind
from tidemark.operators.crosssection import exact_quantiles

HOUR_US = 3_600_000_000


def ohlcv(ticks: DataFrame, *, keys: Sequence[str], clock: str, order: Sequence[str], price: str, qty: str,
          width: int, buy: Column | None = None) -> DataFrame:
    """Open/high/low/close/volume per left-labelled bucket; empty buckets stay absent."""
    o = F.struct(*order)
    p, q = c(price).cast("double"), c(qty).cast("double")
    aggs = [F.min_by(p, o).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, o).alias("close"),
            F.sum(q).alias("volume"), F.sum(p * q).alias("quote_volume"), F.count(F.lit(1)).cast("double").alias("trades")]
    if buy is not None:
        aggs += [F.sum(ind(buy, q)).alias("taker_buy_base"), F.sum(ind(buy, p * q)).alias("taker_buy_quote")]
    return ticks.groupBy(*keys, floor_to(clock, width).alias("bar")).agg(*aggs)


def coarser(bars: DataFrame, *, keys: Sequence[str], width: int, sums: Sequence[str] = ("volume", "quote_volume")) -> DataFrame:
    """Larger bars from smaller ones, with any extra columns summed."""
    return bars.groupBy(*keys, floor_to("bar", width).alias("bucket")).agg(
        F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar").alias("close"), *[F.sum(x).alias(x) for x in sums],
    ).withColumnRenamed("bucket", "bar")


def flow_bars(ticks: DataFrame, *, keys: Sequence[str], clock: str, price: str, qty: str, is_sell: str, width: int,
              large: float) -> DataFrame:
    """Aggressor flow per bucket: sides, counts, sizes, large trades, side VWAPs and signed volume.

    The 95th percentile is exact and ranks a busy bar over many tasks.
    """
    p, q = c(price).cast("double"), c(qty).cast("double")
    usd, sell = p * q, c(is_sell)
    bigger = usd >= large
    bar = floor_to(clock, width).alias("bar")
    tail = exact_quantiles(ticks.select(*keys, bar, usd.alias("_usd")), [*keys, "bar"], "_usd", {"p95_usd": 0.95})
    d = ticks.groupBy(*keys, bar).agg(
        F.sum(ind(~sell, usd)).alias("buy_usd"), F.sum(ind(sell, usd)).alias("sell_usd"),
        F.sum(ind(~sell, q)).alias("buy_qty"), F.sum(ind(sell, q)).alias("sell_qty"),
        F.count(F.lit(1)).alias("n_trades"), F.avg(usd).alias("avg_usd"),
        F.sum(ind(~sell & bigger, usd)).alias("large_buy_usd"), F.sum(ind(sell & bigger, usd)).alias("large_sell_usd"))
    return d.join(tail, [*keys, "bar"]).withColumns({
        "buy_vwap": div("buy_usd", "buy_qty"), "sell_vwap": div("sell_usd", "sell_qty"),
        "signed_volume": c("buy_usd") - c("sell_usd")})


def calendar(df: DataFrame, *, keys: Sequence[str], clock: str, step: int) -> DataFrame:
    """Every grid point of the whole frame's span for every key: gaps become rows."""
    span = df.agg(F.min(clock).alias("a"), F.max(clock).alias("b")).first()
    known = df.select(*keys).distinct()
    if span["a"] is None:
        return known.withColumn(clock, F.lit(None).cast("bigint")).where(F.lit(False))
    first = span["a"] - span["a"] % step
    grid = F.sequence(F.lit(first), F.lit(span["b"]), F.lit(step))
    return known.withColumn(clock, F.explode(grid))


def on_calendar(df: DataFrame, *, keys: Sequence[str], clock: str, step: int) -> DataFrame:
    """The frame on its full calendar; missing cells are null rows."""
    return calendar(df, keys=keys, clock=clock, step=step).join(df, [*keys, clock], "left")


def gap_histogram(seq, clock: str, unit: int) -> DataFrame:
    """How often each distance between neighbours occurs, in units."""
    gap = ((c(clock) - F.lag(clock).over(seq.by())) / unit).cast("bigint")
    d = seq.add({"gap": gap}).result().where(F.col("gap").isNotNull())
    return d.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def drawdown_summary(df: DataFrame, *, by: Sequence[str], order: str, pnl: str) -> DataFrame:
    """Per group: count, mean, profit factor, Sharpe and largest drawdown of the running sum."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_cum", F.sum(pnl).over(w))
    d = d.withColumn("_peak", F.greatest(F.max("_cum").over(w), F.lit(0.0)))
    p = c(pnl)
    return d.groupBy(*by).agg(
        F.count(p).alias("n"), F.avg(p).alias("mean"),
        div(F.sum(ind(p > 0, p)), -F.sum(ind(p < 0, p))).alias("profit_factor"),
        div(F.avg(p), F.stddev_samp(p)).alias("sharpe"), F.max(F.col("_peak") - F.col("_cum")).alias("max_drawdown"))
