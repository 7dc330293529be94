"""Data quality as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, div, ind
from tidemark.operators.blocks import sequence


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(ind(cond)), F.lit(0.0)).cast("bigint")


def bar_checks() -> dict[str, Column]:
    """Row predicates that a valid bar must not meet."""
    o, h, l, cl, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return {"bad_high": h < F.greatest(o, cl, l), "bad_low": l > F.least(o, cl, h), "not_positive": (o <= 0) | (l <= 0), "negative_volume": v < 0}


def frame_gate(df: DataFrame, *, key: str, clock: str, arrival: Sequence[str], values: Sequence[str], step: int) -> DataFrame:
    """One row: rows, nulls, constants, steps back in arrival order, gaps above 1.5 steps."""
    s = sequence(df, [key], [clock, *[a for a in arrival if a != clock]], back=1)
    gap = F.col(clock) - F.lag(clock).over(s.by())
    d = s.add({"_gap": gap}).result()
    aggs = [F.count(F.lit(1)).alias("n_rows"), count_if(F.col("_gap") > 1.5 * step).alias("n_gaps"), count_if(F.col("_gap") == 0).alias("n_repeated")]
    for v in values:
        aggs += [count_if(c(v).isNull()).alias(f"null_{v}"), (F.min(v) == F.max(v)).alias(f"constant_{v}")]
    return d.agg(*aggs)


def series_coverage(df: DataFrame, *, key: str, clock: str, step: int) -> DataFrame:
    """Per key: span, expected and actual rows, coverage, gaps, longest gap."""
    s = sequence(df.select(key, clock).distinct(), [key], [clock], back=1)
    d = s.add({"_gap": F.col(clock) - F.lag(clock).over(s.by())}).result()
    d = d.groupBy(key).agg(F.min(clock).alias("first"), F.max(clock).alias("last"), F.count(F.lit(1)).alias("actual"),
                           count_if(F.col("_gap") > 1.5 * step).alias("n_gaps"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap"))
    exp = ((F.col("last") - F.col("first")) / step + 1).cast("bigint")
    return d.withColumns({"expected": exp, "coverage": F.col("actual") / exp})


def gaps(df: DataFrame, *, key: str, clock: str, step: int, factor: float = 1.5) -> DataFrame:
    """(key, from, to, missing) for each gap above ``factor`` steps."""
    s = sequence(df.select(key, clock).distinct(), [key], [clock], back=1)
    d = s.add({"gap_from": F.lag(clock).over(s.by())}).result()
    d = d.where(F.col(clock) - F.col("gap_from") > factor * step)
    return d.select(key, "gap_from", F.col(clock).alias("gap_to"), ((F.col(clock) - F.col("gap_from")) / step - 1).cast("bigint").alias("missing"))


def completeness(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    shares = {f: F.avg(ind(c(f).isNotNull())) for f in fields}
    mean = sum(shares.values()) / len(shares)
    return df.groupBy(*by).agg(*[v.alias(f"share_{k}") for k, v in shares.items()], mean.alias("completeness"))


def set_drift(frozen: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, side): names only in one of two sets."""
    gone = frozen.select(key).exceptAll(current.select(key)).withColumn("side", F.lit("gone"))
    new = current.select(key).exceptAll(frozen.select(key)).withColumn("side", F.lit("new"))
    return gone.unionByName(new)
