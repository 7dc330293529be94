"""Event detectors with their thresholds as parameters; the defaults are those of the protocol."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clip, div
from tidemark.operators import rolling as R
from tidemark.operators.blocks import Seq, sequence
from tidemark.operators.crosssection import over


def _flag(s: Seq, out: str, hit: Column, drop: tuple[str, ...] = ()) -> Seq:
    s = s.add({out: F.coalesce(hit, F.lit(False))})
    return replace(s, df=s.df.drop(*drop))


def deleveraging(s: Seq, *, residual: str, oi_change: str, sells: str, volume: str, window: int, shock: float = 1.5, drop: float = 0.03, sell_rank: float = 0.90, volume_rank: float = 0.80, out: str = "deleveraging") -> Seq:
    """A fall beyond ``shock`` prior deviations, open interest down by ``drop``, extreme selling and high volume; adds the two ranks."""
    s = s.add({"sell_rank": R.prior_rank_share(s, sells, window), "volume_rank": R.prior_rank_share(s, volume, window), "_sd": R.prior(s, F.stddev_samp, residual, window)})
    return _flag(s, out, (c(residual) <= -shock * c("_sd")) & (c(oi_change) <= -drop) & (c("sell_rank") >= sell_rank) & (c("volume_rank") >= volume_rank), ("_sd",))


def span_rank(s: Seq, x: str, span: int) -> Column:
    """Share of the values in [t - span, t) that are not above the current one. A frame holds what its keys have in ``span``."""
    got = F.collect_list(x).over(s.by().rangeBetween(-span, -1))
    return F.when(c(x).isNotNull(), div(F.size(F.filter(got, lambda v: v <= c(x))).cast("double"), F.size(got)))


def crowding(s: Seq, *, funding: str, funding_rank: str, basis_z: str, oi_change: str, buys: str, sells: str, rank: float = 0.90, z: float = 2.0, build: float = 0.03, out: str = "crowding") -> Seq:
    """Extreme funding and basis with open interest building up, flow on the side that pays; adds ``crowded_side``."""
    same = F.signum(c(buys) - c(sells)) == F.signum(c(funding))
    s = s.add({"crowded_side": F.when(c(funding) > 0, "long").otherwise("short")})
    return _flag(s, out, (c(funding_rank) >= rank) & (F.abs(c(basis_z)) >= z) & (c(oi_change) >= build) & same)


def dislocation(df: DataFrame, *, at: str, name: str, residual: str, basis_z: str, flow: str, available: str, window: int, shock: float = 2.0, z: float = 2.0, bound: int | None = None, out: str = "dislocated") -> DataFrame:
    """Names whose residual, relative basis and relative flow are all extreme and of one sign.

    The residual is held against its own prior deviation, the others against all names of the instant. Adds the two
    relative values, ``_sign`` of the residual, and ``known_at``: the latest clock among names that contributed anything.
    """
    gave = c(residual).isNotNull() | c(basis_z).isNotNull() | c(flow).isNotNull()
    d = df.withColumns({"relative_basis": c(basis_z) - over([at], F.percentile(basis_z, F.lit(0.5))), "relative_flow": div(c(flow) - over([at], F.avg(flow)), over([at], F.stddev_samp(flow))), "known_at": over([at], F.max(F.when(gave, c(available))))})
    s = sequence(d, [name], [at], back=window, bound=bound)
    s = s.add({"_sd": R.prior(s, F.stddev_samp, residual, window), "trigger_sign": F.signum(c(residual))})
    same = (F.signum("relative_basis") == F.signum("relative_flow")) & (F.signum("relative_flow") == c("trigger_sign"))
    return _flag(s, out, (F.abs(c(residual)) >= shock * c("_sd")) & (F.abs("relative_basis") >= z) & (F.abs("relative_flow") >= z) & same, ("_sd",)).result()


def ignition(s: Seq, *, oi: str, taker: str, price: str, lag: int = 6, window: int = 2016, warm: int = 864, oi_z: float = 3.0, taker_z: float = 1.0, thrust: float = 0.003, out: str = "ignition") -> Seq:
    """Open interest expands by ``oi_z`` prior deviations, with taker buying and a rise; adds the change and scores."""
    s = s.add({"oi_change": R.pct_change(s, oi, lag), "thrust": R.pct_change(s, price, lag)})
    s = s.add({"oi_z": R.prior_z(s, "oi_change", window, warm), "taker_z": R.prior_z(s, taker, window, warm)})
    return _flag(s, out, (c("oi_z") >= oi_z) & (c("oi_change") > 0) & (c("taker_z") >= taker_z) & (c("thrust") >= thrust))


def flush(s: Seq, *, oi: str, price: str, funding: str | None = None, lag: int = 4, drop: float = 0.03, fall: float = 0.02, least_funding: float | None = None, out: str = "flush") -> Seq:
    """Open interest and price fall together over ``lag`` rows; with ``least_funding`` only after funding at least as high before."""
    s = s.add({"oi_change": R.pct_change(s, oi, lag), "price_change": R.pct_change(s, price, lag)})
    hit = (c("oi_change") <= -drop) & (c("price_change") <= -fall)
    return _flag(s, out, hit & (R.lag(s, funding, lag) >= least_funding) if funding and least_funding is not None else hit)


def repeat_bucket(prior: Column, exhausted: int = 2) -> Column:
    return F.when(prior == 0, "onset").when(prior >= exhausted, "exhaustion").otherwise("mid")


def covering_state(price_rank: Column, oi_rank: Column, high: float = 0.90, low: float = 0.10) -> tuple[Column, Column]:
    """(state, score): short covering is a price in its top and open interest in its bottom tail; the score is the weaker of the two."""
    known = price_rank.isNotNull() & oi_rank.isNotNull()
    state = F.when(known & (price_rank >= high) & (oi_rank <= low), "SHORT_COVERING").otherwise("OTHER")
    return state, F.when(known, clip(F.least(price_rank, 1.0 - oi_rank), 0.0, 1.0)).otherwise(0.0)


def shock_levels(events: DataFrame, *, clock: str, order: list[str], x: str, span: int, q: float = 0.90, least: int = 200, out: str = "level") -> DataFrame:
    """Adds the quantile of |x| over the events before (in order) and no more than ``span`` back; missing below ``least`` of them.

    Stretches of ``span`` are groups of their own, each with the stretch before it, so a task holds two of them.
    """
    home = F.floor(c(clock) / span)
    d = events.withColumn("_home", home).withColumn("_part", F.explode(F.array(home, home + 1)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([clock, *order], kind="stable").reset_index(drop=True)
        t, v = pdf[clock].to_numpy(), pdf[x].abs().to_numpy(dtype="float64")
        level, held, lo = np.full(len(t), np.nan), [], 0
        for i in range(len(t)):
            while t[lo] < t[i] - span:
                del held[bisect_left(held, v[lo])]
                lo += 1
            if len(held) >= least:
                k = q * (len(held) - 1)
                low = int(k)
                top = held[min(low + 1, len(held) - 1)]
                level[i] = held[low] + (top - held[low]) * (k - low)
            insort(held, v[i])
        pdf[out] = level
        return pdf[pdf["_home"] == pdf["_part"]].drop(columns=["_home", "_part"])

    got = d.groupBy("_part").applyInPandas(slide, f"{kinds}, {out} double")
    return got.withColumn(out, F.when(~F.isnan(out), c(out)))


def systemic(events: DataFrame, density: str, least: int) -> DataFrame:
    return events.where(c(density) >= least)


def leader_values(d: DataFrame, at: str, name: str, leader: str, x: str, out: str) -> DataFrame:
    """Adds the leader's value of the same instant to every row."""
    return d.withColumn(out, F.max(F.when(c(name) == leader, c(x))).over(Window.partitionBy(at)))
