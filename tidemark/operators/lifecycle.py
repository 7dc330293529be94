"""Instrument snapshots, lifecycles and venue precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, ind


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change, field, old, new): names added and removed, and each field that differs."""
    a = prev.select(key, F.lit(True).alias("_a"), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = cur.select(key, F.lit(True).alias("_b"), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    d = a.join(b, key, "full")
    none = F.lit(None).cast("string")
    row = lambda kind, f, o, n: F.struct(F.lit(kind).alias("change"), F.lit(f).alias("field"), o.alias("old"), n.alias("new"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rows = [F.when(F.col("_a").isNull(), row("added", "", none, none)), F.when(F.col("_b").isNull(), row("removed", "", none, none))]
    rows += [F.when(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), row("changed", f, F.col(f"a_{f}"), F.col(f"b_{f}"))) for f in fields]
    return d.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*")


def reconcile_start(sources: dict[str, Column], tolerance: int) -> tuple[Column, Column, Column]:
    """(earliest proven clock, its source, conflict): conflict if the claims differ by more than the tolerance."""
    first = F.least(*sources.values()) if len(sources) > 1 else next(iter(sources.values()))
    last = F.greatest(*sources.values())
    tag = F.lit(None).cast("string")
    for k, v in reversed(list(sources.items())):
        tag = F.when(v == first, F.lit(k)).otherwise(tag)
    return first, tag, F.coalesce(last - first > tolerance, F.lit(False))


def precedence(launches: DataFrame, instruments: DataFrame, asset: str, launch: str, base: str, listed: str, venue: str) -> DataFrame:
    """Per launched asset: which venue listed it first, with confidence and lead days.

    Leading "1000"-style multipliers are ignored when bases are compared.
    """
    norm = lambda x: F.regexp_replace(F.upper(x), r"^(1000000|10000|1000|1M)", "")
    l = launches.select(F.col(asset).alias("asset"), norm(F.col(asset)).alias("base"), F.col(launch).alias("launch"))
    i = instruments.select(norm(F.col(base)).alias("base"), F.col(listed).alias("listed"), F.col(venue).alias("venue"))
    # Instruments combine per base before the join: the earliest listings as a short sorted list per venue.
    per = i.groupBy("base", "venue").agg(F.min("listed").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(ind(F.col("listed").isNull())).cast("bigint").alias("undated"))
    per = per.groupBy("base").agg(F.min_by("venue", F.when(F.col("first").isNotNull(), F.struct("first", "venue"))).alias("first_venue"), F.min("first").alias("first"), F.sum("n").alias("n_instruments"), F.sum("undated").alias("n_undated"))
    d = l.join(per, "base", "left")
    before = F.col("first") < F.col("launch")
    kind = F.when(before, "OTHER_VENUE_FIRST").when(F.col("n_undated") > 0, "UNKNOWN_PRECEDENCE").when(F.col("n_instruments") > 0, "HOME_FIRST").otherwise("NO_OTHER_VENUE")
    sure = F.when(kind == "UNKNOWN_PRECEDENCE", "low").otherwise("high")
    return d.select("asset", "base", kind.alias("classification"), sure.alias("confidence"), F.when(before, F.col("first_venue")).alias("first_venue"),
                    F.when(before, F.round((F.col("launch") - F.col("first")) / 86_400e6, 2)).alias("lead_days"), F.coalesce("n_instruments", F.lit(0)).cast("bigint").alias("n_instruments"))


def lead_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 1, "<1d").when(days < 7, "1-7d").when(days < 30, "7-30d").when(days < 180, "30-180d").otherwise(">=180d")


def missing_reasons(**needed: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in sorted(needed.items())]))
