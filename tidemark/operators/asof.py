"""As-of joins, interval sums and one-to-one matching on clocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import BLOCK_ROWS, TB, carried, cut

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Context:
    """A right side of an as-of join: its clock, the columns to attach and their prefix."""

    df: DataFrame
    clock: str
    cols: Sequence[str]
    prefix: str = ""
    tie: Sequence[str] = ()
    tolerance: int | None = None


def asof_contexts(left: DataFrame, contexts: Sequence[Context], *, by: Sequence[str], left_clock: str,
                  direction: str = "backward", exact: bool = True, width: int = DAY_US,
                  target: int = BLOCK_ROWS) -> DataFrame:
    """For each left row the newest row of every context at or before its clock (or the next at or after).

    All sides are stacked, cut into clock blocks per key (hot blocks split), and the last
    row of each context is taken inside the block. Each block also gets one carried row:
    the newest context rows of any earlier block. No pair of rows is ever formed, and any
    number of contexts costs one shuffle. Adds ``prefix+col`` and ``prefix+clock`` per
    context; values older than its tolerance are null.
    """
    by = list(by)
    sign = 1 if direction == "backward" else -1
    right_tag, left_tag = (0, 1) if exact else (1, 0)
    names = [f"_v{i}" for i in range(len(contexts))]
    rights, types = [], []
    for ctx in contexts:
        value = F.struct(F.col(ctx.clock).cast("bigint").alias("_rc"), *[F.col(x) for x in ctx.cols])
        tie = F.struct(*ctx.tie) if ctx.tie else F.lit(0)
        # One row per (key, clock): the last by the tie columns going backward, the first going forward.
        pick = F.max_by if sign == 1 else F.min_by
        r = ctx.df.where(F.col(ctx.clock).isNotNull()).groupBy(*by, (F.col(ctx.clock) * sign).cast("bigint").alias("_clk"))
        r = r.agg(pick(value, tie).alias("_v"))
        rights.append(r)
        types.append(r.schema["_v"].dataType)
    row_type = left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType
    none = [F.lit(None).cast(t).alias(n) for n, t in zip(names, types)]
    no_row = F.lit(None).cast(row_type).alias("_row")
    u = left.select(*by, (F.col(left_clock) * sign).cast("bigint").alias("_clk"), F.lit(left_tag).alias("_tag"), *none,
                    F.struct(*left.columns).alias("_row"))
    for i, r in enumerate(rights):
        vals = [F.col("_v").alias(n) if j == i else none[j] for j, n in enumerate(names)]
        u = u.unionByName(r.select(*by, "_clk", F.lit(right_tag).alias("_tag"), *vals, no_row))
    u, blocks = cut(u, by, "_clk", width, target)
    ends = u.where(F.col("_tag") == right_tag).groupBy(*by, TB).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_clk"))).alias(n) for n in names])
    back = carried(blocks, ends, by, lambda n: F.last(n, ignorenulls=True), names)
    u = u.unionByName(back.select(*by, F.col(TB).alias("_clk"), F.lit(-1).alias("_tag"), *names, no_row, TB))
    w = Window.partitionBy(*by, TB).orderBy("_clk", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names})
    u = u.where((F.col("_tag") == left_tag) & F.col("_row").isNotNull())
    out = [F.col(f"_row.{x}").alias(x) for x in left.columns]
    for n, ctx in zip(names, contexts):
        hit = F.col(n)
        if ctx.tolerance is not None:
            hit = F.when(F.abs(F.col("_clk") * sign - hit["_rc"]) <= ctx.tolerance, hit)
        out += [hit[x].alias(ctx.prefix + x) for x in ctx.cols]
        out.append(hit["_rc"].alias(ctx.prefix + ctx.clock if ctx.prefix or ctx.clock not in left.columns else ctx.clock + "_r"))
    return u.select(*out)


def asof_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_clock: str, right_clock: str,
              cols: Sequence[str], prefix: str = "", tie: Sequence[str] = (), direction: str = "backward",
              tolerance: int | None = None, exact: bool = True, width: int = DAY_US,
              target: int = BLOCK_ROWS) -> DataFrame:
    """As-of join with one context."""
    ctx = Context(right, right_clock, list(cols), prefix, tuple(tie), tolerance)
    return asof_contexts(left, [ctx], by=by, left_clock=left_clock, direction=direction, exact=exact, width=width, target=target)


def cumulative_at(left: DataFrame, steps: DataFrame, *, by: Sequence[str], left_clock: Column, values: Sequence[str],
                  width: int = DAY_US, target: int = BLOCK_ROWS) -> DataFrame:
    """Running sums of ``steps`` seen by each left row.

    ``steps`` has the keys, ``_clk``, ``_late`` (counted only by strictly later rows) and
    the values. One pass over both sides; earlier blocks arrive as carried sums.
    """
    by, values = list(by), list(values)
    s = steps.groupBy(*by, "_clk", "_late").agg(*[F.sum(v).alias(v) for v in values])
    row_type = left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType
    types = {v: s.schema[v].dataType for v in values}
    u = left.select(*by, left_clock.cast("bigint").alias("_clk"), F.lit(1).alias("_tag"),
                    *[F.lit(None).cast(types[v]).alias(v if v not in left.columns else v) for v in values],
                    F.struct(*left.columns).alias("_row"))
    u = u.unionByName(s.select(*by, F.col("_clk").cast("bigint").alias("_clk"), F.when(F.col("_late"), 2).otherwise(0).alias("_tag"),
                               *values, F.lit(None).cast(row_type).alias("_row")))
    u, blocks = cut(u, by, "_clk", width, target)
    sums = u.where(F.col("_tag") != 1).groupBy(*by, TB).agg(*[F.sum(v).alias(v) for v in values])
    off = carried(blocks, sums, by, F.sum, values).select(*by, TB, *[F.col(v).alias(f"_o_{v}") for v in values])
    w = Window.partitionBy(*by, TB).orderBy("_clk", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    u = u.join(off, [*by, TB]).withColumns({
        v: F.coalesce(F.col(f"_o_{v}"), zero) + F.coalesce(F.sum(v).over(w), zero) for v in values})
    u = u.where(F.col("_row").isNotNull())
    keep = [x for x in left.columns if x not in values]
    return u.select(*[F.col(f"_row.{x}").alias(x) for x in keep], *values)


def window_sums(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_clock: str, right_clock: str, lo: int, hi: int,
                values: dict[str, Column], lo_open: bool = False, hi_open: bool = False, width: int = DAY_US) -> DataFrame:
    """Sums of right rows with clock in [t + lo, t + hi] of each left row at t.

    A right row enters the running sum when the window reaches it and leaves it when the
    window has passed, so the cost does not depend on how many rows a window covers.
    """
    by = list(by)
    r = right.select(*by, F.col(right_clock).alias("_r"), *[v.alias(k) for k, v in values.items()])
    enter = r.select(*by, (F.col("_r") - hi).alias("_clk"), F.lit(hi_open).alias("_late"), *values)
    leave = r.select(*by, (F.col("_r") - lo).alias("_clk"), F.lit(not lo_open).alias("_late"), *[(-F.col(k)).alias(k) for k in values])
    return cumulative_at(left, enter.unionByName(leave), by=by, left_clock=F.col(left_clock), values=list(values), width=width)


def interval_sums(left: DataFrame, right: DataFrame, *, by: Sequence[str], lo: Column, hi: Column,
                  right_clock: str, values: dict[str, Column], lo_open: bool = True, hi_open: bool = False,
                  width: int = DAY_US) -> DataFrame:
    """Sums of right rows whose clock lies between ``lo`` and ``hi``, which differ per left row.

    Two look-ups on running totals. ``lo_open`` drops right rows at exactly ``lo``.
    """
    by, keep = list(by), left.columns
    r = right.select(*by, F.col(right_clock).alias("_clk"), *[v.alias(k) for k, v in values.items()])
    up = {k: f"_h_{k}" for k in values}
    d = cumulative_at(left, r.select(*by, "_clk", F.lit(hi_open).alias("_late"), *[F.col(k).alias(up[k]) for k in values]),
                      by=by, left_clock=hi, values=list(up.values()), width=width)
    d = cumulative_at(d, r.withColumn("_late", F.lit(not lo_open)), by=by, left_clock=lo, values=list(values), width=width)
    return d.select(*keep, *[(F.col(up[k]) - F.col(k)).alias(k) for k in values])


def interval_pairs(left: DataFrame, right: DataFrame, *, by: Sequence[str], lo: str, hi: str, right_clock: str,
                   width: int) -> DataFrame:
    """Rows of ``right`` inside [lo, hi] of ``left``: equi-join on clock cells, then the exact test.

    Only for right sides whose density per interval is bounded by their grid; sums use
    ``interval_sums``.
    """
    by = list(by)
    l = left.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    r = right.withColumn("_cell", F.floor(F.col(right_clock) / width))
    return l.join(r, [*by, "_cell"]).where(F.col(right_clock).between(F.col(lo), F.col(hi))).drop("_cell")


def mutual_matches(a: DataFrame, b: DataFrame, *, by: Sequence[str], a_clock: str, b_clock: str, a_id: str, b_id: str,
                   tolerance: int) -> DataFrame:
    """One row per a/b row with its status: matched, ambiguous or unmatched.

    A pair is accepted only when each side has exactly one candidate within the
    tolerance and they are each other's. Candidates are counted by ordered look-back
    and look-ahead, so crowded clocks cost no pairs: two or more candidates is all
    that has to be known.
    """
    by = list(by)
    one = F.lit(1)
    ca = window_sums(a, b, by=by, left_clock=a_clock, right_clock=b_clock, lo=-tolerance, hi=tolerance, values={"n_other": one})
    cb = window_sums(b, a, by=by, left_clock=b_clock, right_clock=a_clock, lo=-tolerance, hi=tolerance, values={"n_other": one})
    single = ca.where(F.col("n_other") == 1).withColumn("_from", F.col(a_clock) - tolerance)
    rb = cb.select(*by, F.col(b_clock).alias("_bclk"), F.col(b_id).alias("_bid"), F.col("n_other").alias("_nb"))
    hit = asof_join(single, rb, by=by, left_clock="_from", right_clock="_bclk", cols=["_bid", "_nb"], prefix="m",
                    direction="forward")
    pairs = hit.where(F.col("m_nb") == 1).select(
        *by, F.col(a_id).alias("a_id"), F.col("m_bid").alias("b_id"), (F.col("m_bclk") - F.col(a_clock)).alias("offset"))
    left = ca.select(*by, F.col(a_id).alias("a_id"), F.col("n_other").alias("n_other"))
    left = left.join(pairs.select("a_id", "b_id", "offset"), "a_id", "left")
    status = F.when(F.col("b_id").isNotNull(), "matched").when(F.col("n_other") == 0, "unmatched").otherwise("ambiguous")
    return left.withColumn("status", status)
