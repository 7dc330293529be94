"""Event detection helpers: keep-first cooldowns, episodes and trailing counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import c
from tidemark.operators import rolling as R
from tidemark.operators.asof import DAY_US, cumulative_at, window_sums
from tidemark.operators.blocks import BLK, BLOCK_ROWS, CORE, Seq, running_total, sequence
from tidemark.session import pin

ANCHOR = "anchor"
#: Least flow rank, largest change of open interest, and least residual in standard deviations of a forced-flow reversal.
FLOW_RANK, OI_DROP, SHOCK = 0.95, -0.05, 2.5


def _next(t: np.ndarray, start: np.ndarray | int, gap: int, strict: bool) -> np.ndarray:
    return np.searchsorted(t, start + gap, side="right" if strict else "left")


def greedy_anchors(df: DataFrame, keys: Sequence[str], clock: str, gap: int, *, strict: bool = False,
                   size: int = BLOCK_ROWS) -> DataFrame:
    """Add ``anchor``: the clock of the newest kept row at or before each row.

    A row is kept when it lies at least ``gap`` (strict: more) after the last kept row.
    Exact over keys of any size in three steps: each block reports, for the few rows that
    could be its first kept one, where the chain from there ends; a fold over these
    short reports gives each block the kept row it starts from; each block then marks its
    rows. The reports hold at most the distinct clocks within one ``gap`` of a block's start.
    """
    keys = list(keys)
    ticks = df.select(*keys, clock).distinct()
    s = sequence(ticks, keys, [clock], size=size)
    schema_of = {f.name: f.dataType for f in df.schema.fields}
    key_fields = [T.StructField(k, schema_of[k]) for k in keys]
    longs = T.ArrayType(T.LongType())
    base = s.df.where(CORE).select(*keys, BLK, F.col(clock).cast("bigint").alias(clock))

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[clock].to_numpy("int64"))
        nxt = _next(t, t, gap, strict)
        end = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                end[i] = end[nxt[i]]
        reach = int(_next(t, int(t[0]), gap, strict)) + 1
        row = {k: pdf[k].iloc[0] for k in keys} | {BLK: pdf[BLK].iloc[0], "t": t[:reach].tolist(), "e": end[:reach].tolist()}
        return pd.DataFrame([row])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLK)
        last, held = None, []
        for t, e in zip(pdf["t"], pdf["e"]):
            held.append(last)
            i = 0 if last is None else int(_next(np.asarray(t), last, gap, strict))
            if i < len(t):
                last = int(e[i])
        return pdf[[*keys, BLK]].assign(held=pd.array(held, dtype="Int64"))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(clock)
        t = pdf[clock].to_numpy("int64")
        held = pdf["held"].iloc[0]
        out = np.empty(len(t), "int64")
        i = 0
        if not pd.isna(held):
            i = int(_next(t, int(held), gap, strict))
            out[:i] = int(held)
        while i < len(t):
            j = int(_next(t, int(t[i]), gap, strict))
            out[i:j] = t[i]
            i = j
        return pdf[[*keys, clock]].assign(anchor=out)

    mark_schema = T.StructType(key_fields + [T.StructField(clock, T.LongType()), T.StructField(ANCHOR, T.LongType())])
    if s.single:
        marked = base.withColumn("held", F.lit(None).cast("bigint")).groupBy(*keys, BLK).applyInPandas(mark, mark_schema)
        return df.join(marked, [*keys, clock], "left")
    reports = base.groupBy(*keys, BLK).applyInPandas(report, T.StructType(
        key_fields + [T.StructField(BLK, T.LongType()), T.StructField("t", longs), T.StructField("e", longs)]))
    starts = reports.groupBy(*keys).applyInPandas(fold, T.StructType(
        key_fields + [T.StructField(BLK, T.LongType()), T.StructField("held", T.LongType())]))
    marked = base.join(starts, [*keys, BLK]).groupBy(*keys, BLK).applyInPandas(mark, mark_schema)
    return df.join(marked, [*keys, clock], "left")


def cooldown(df: DataFrame, keys: Sequence[str], clock: str, gap: int, *, strict: bool = False, size: int = BLOCK_ROWS) -> DataFrame:
    """Only the rows that a keep-first cooldown of ``gap`` lets through (one per clock)."""
    d = greedy_anchors(df, keys, clock, gap, strict=strict, size=size)
    return d.where(F.col(ANCHOR) == F.col(clock)).drop(ANCHOR)


def session_ids(df: DataFrame, keys: Sequence[str], clock: str, order: Sequence[str], gap: int, out: str,
                width: int = DAY_US) -> DataFrame:
    """Episode number from 0 per key: a new one when the gap to the row before exceeds ``gap``."""
    s = sequence(df, keys, order, back=1)
    new = F.coalesce((c(clock) - F.lag(clock).over(s.by()) > gap).cast("bigint"), F.lit(0).cast("bigint"))
    d = s.add({"_new": new}).result()
    return running_total(d, keys, order, {out: F.col("_new")}, width).drop("_new")


def fixed_window_ids(clock: str, width: int) -> Column:
    return F.floor(c(clock) / width)


def trailing_counts(df: DataFrame, keys: Sequence[str], clock: str, span: int, out: str) -> DataFrame:
    """Rows of the key with clock in [t - span, t)."""
    right = df.select(*keys, F.col(clock).alias("_at"))
    return window_sums(df, right, by=keys, left_clock=clock, right_clock="_at", lo=-span, hi=0, values={out: F.lit(1)}, hi_open=True)


def other_names_within(df: DataFrame, name: str, clock: str, span: int, out: str, width: int = DAY_US) -> DataFrame:
    """Number of other names with a row in (t - span, t) at each row.

    A name is active from just after one of its rows until ``span`` later. Overlapping
    activities of a name merge into stretches; the answer is stretches begun minus
    stretches ended, so no pair of rows is formed.
    """
    ticks = df.select(name, F.col(clock).cast("bigint").alias("_t")).distinct()
    s = sequence(ticks, [name], ["_t"], back=1, ahead=1)
    near = lambda k: F.abs(F.lag("_t", k).over(s.by()) - F.col("_t")) < span
    d = s.add({"_begins": ~F.coalesce(near(1), F.lit(False)), "_ends": ~F.coalesce(near(-1), F.lit(False))}).result()
    # A stretch counts from strictly after its first row up to, not including, span after its last row.
    opened = d.where("_begins").select(name, F.col("_t").alias("_clk"), F.lit(True).alias("_late"), F.lit(1).alias("n"))
    closed = d.where("_ends").select(name, (F.col("_t") + span).alias("_clk"), F.lit(False).alias("_late"), F.lit(-1).alias("n"))
    turns = pin(opened.unionByName(closed))
    d = cumulative_at(df, turns.withColumnRenamed("n", "_all").drop(name), by=[], left_clock=c(clock), values=["_all"], width=width)
    d = cumulative_at(d, turns.withColumnRenamed("n", "_own"), by=[name], left_clock=c(clock), values=["_own"], width=width)
    return d.withColumn(out, (F.col("_all") - F.col("_own")).cast("bigint")).select(*df.columns, out)


def zone(p: Column, tau_a: Column, tau_b: Column) -> Column:
    return F.when(p >= tau_a, "A").when(p >= tau_b, "B").otherwise("C")


def forced_flow(s: Seq, signed_volume: str, oi_change: str, residual: str, window: int, rank: float = FLOW_RANK, drop: float = OI_DROP, shock: float = SHOCK,
                liquidations: str | None = None, feed: str | None = None, out: str = "forced_flow") -> Seq:
    """Flag rows of extreme flow, falling open interest and a price shock; also ``flow_rank``.

    Ranks and deviations are over the ``window`` rows strictly before, all of which must be present. Where ``feed``
    is true the rank of ``liquidations`` (missing as 0) takes the place of the flow's.
    """
    cols = {"_flow": F.abs(signed_volume)} | ({"_liq": F.coalesce(F.col(liquidations), F.lit(0.0))} if liquidations else {})
    s = s.add(cols)
    place = R.prior_rank_share(s, "_flow", window)
    if liquidations:
        place = F.when(F.coalesce(F.col(feed), F.lit(False)), R.prior_rank_share(s, "_liq", window)).otherwise(place)
    s = s.add({"flow_rank": place, "_sd": R.prior(s, F.stddev_samp, residual, window)})
    hit = (F.col("flow_rank") >= rank) & (F.col(oi_change) <= drop) & (F.abs(residual) >= shock * F.col("_sd"))
    s = s.add({out: F.coalesce(hit, F.lit(False))})
    return replace(s, df=s.df.drop("_sd", *cols))
