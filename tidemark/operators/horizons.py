"""Features of larger bars on smaller ones, and how their trends agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag, safe_div
from tidemark.operators import recurrence as K
from tidemark.operators import resample as D
from tidemark.operators import rolling as R
from tidemark.operators.asof import Context, asof_contexts
from tidemark.operators.blocks import sequence

#: Columns of a larger bar.
PARTS = ("trend", "rsi", "volatility", "support", "resistance", "vwap", "distance_sma")
LEAST = 5


def higher_bars(bars: DataFrame, keys: Sequence[str], clock: str, width: int, bound: int | None = None) -> DataFrame:
    """Each bar of ``width`` with what was known when it began: the PARTS of the bar before it."""
    h = D.coarser(bars.withColumnRenamed(clock, "bar"), keys=keys, width=width, sums=["volume"])
    s = sequence(h, list(keys), ["bar"], back=2 * K.warmup(50), bound=bound)
    s = K.kernel_pass(s, {"e21": (K.ema(21), ["close"]), "e50": (K.ema(50), ["close"]), "rsi": (K.rsi(14), ["close"])})
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    s = s.add({"_lr": F.ln(F.col("close") / R.lag(s, "close")), "_sma": R.mean(s, "close", 20, LEAST), "_pv": typical * F.col("volume")})
    s = s.add({"trend": F.signum(F.col("e21") - F.col("e50")), "volatility": R.std(s, "_lr", 20, LEAST), "support": R.low(s, "low", 20, LEAST), "resistance": R.high(s, "high", 20, LEAST),
               "vwap": safe_div(R.total(s, "_pv", 20, 1), R.total(s, "volume", 20, 1)), "distance_sma": safe_div(F.col("close") - F.col("_sma"), F.col("_sma"))})
    return s.add({f"_{p}": R.lag(s, p) for p in PARTS}).result(*keys, "bar", *[F.col(f"_{p}").alias(p) for p in PARTS])


def higher_timeframes(bars: DataFrame, keys: Sequence[str], clock: str, widths: dict[str, int], bound: int | None = None) -> DataFrame:
    """``bars`` with ``higher_timeframe_<part>_<name>`` for each width, and the scores of how the trends fit the bar's own move.

    Only bars that had ended count. A flat bar agrees with no trend; a trend that is missing counts as no agreement. Where
    no trend is known the scores are 0.
    """
    keys = list(keys)
    sides = [Context(higher_bars(bars, keys, clock, w, bound).withColumnRenamed("bar", "began"), "began", list(PARTS), f"{n}_") for n, w in widths.items()]
    d = asof_contexts(bars, sides, by=keys, left_clock=clock)
    named = {f"{n}_{p}": f"higher_timeframe_{p}_{n}" for n in widths for p in PARTS}
    d = d.select(*bars.columns, *[F.col(a).alias(b) for a, b in named.items()])
    s = sequence(d, keys, [clock], back=24, bound=bound)
    s = s.add({"_move": F.signum(F.col("close") - R.lag(s, "close")), "lower_timeframe_momentum": R.pct_change(s, "close", 3), "_top": F.when(F.count("close").over(s.rows(-20, -1)) >= LEAST, F.max("close").over(s.rows(-20, -1)))})
    trends = [F.col(f"higher_timeframe_trend_{n}") for n in widths]
    move = F.when(F.col("_move") != 0, F.col("_move"))
    same = [F.coalesce(t == move, F.lit(False)) for t in trends]
    count = lambda xs: sum((x.cast("double") for x in xs[1:]), xs[0].cast("double"))
    known = count([t.isNotNull() for t in trends])
    mean: Column = F.when(known > 0, sum((F.coalesce(t, F.lit(0.0)) for t in trends[1:]), F.coalesce(trends[0], F.lit(0.0))) / known)
    s = s.add({"alignment_score": safe_div(count(same), known), "conflict_score": F.when(known > 0, safe_div(count([~x for x in same]), known)).otherwise(0.0), "long_term_trend_short_term_pullback": flag((mean > 0) & (F.col("lower_timeframe_momentum") < 0)),
               "short_term_breakout_in_long_term_trend": flag((mean > 0) & (F.col("close") > F.col("_top")))})
    return s.result().drop("_move", "_top")
