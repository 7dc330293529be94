"""Point-in-time clocks, leak guards, identities and plane merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, ind, row_hash
from tidemark.operators.blocks import sequence

SECOND_US = 1_000_000
# Publication lag per kind of source, the safety margin and the execution delay.
LAG_US = {"daily": 30 * 3600 * SECOND_US, "monthly": 5 * 86400 * SECOND_US, "snapshot": 60 * SECOND_US}
MARGIN_US = 5 * SECOND_US
EXECUTION_US = 150_000


def availability(df: DataFrame, *, event: str, kind: str, live: bool, bar_seconds: int, received: str | None = None) -> DataFrame:
    """Add the four clocks (µs): market, archive, research and execution availability."""
    market = c(event) + bar_seconds * SECOND_US
    archive = F.coalesce(c(received), market + LAG_US[kind]) if received else market + LAG_US[kind]
    research = (market if live else archive) + MARGIN_US
    return df.withColumns({"market_available": market, "archive_published": archive, "research_available": research,
                           "execution_available": archive + EXECUTION_US})


def daily_watermark(now: Column, lag_us: int, bar_us: int) -> Column:
    """Last bar of the newest UTC day whose end plus lag has passed."""
    day = 86400 * SECOND_US
    shifted = now - lag_us
    return shifted - F.pmod(shifted, F.lit(day)) - bar_us


def late_rows(df: DataFrame, asof: str, available: str) -> DataFrame:
    """Rows whose value was not yet available at ``asof``."""
    return df.where(c(available) > c(asof))


def causality_report(df: DataFrame, asof: str, clocks: Sequence[str]) -> DataFrame:
    """One row: per clock the number of leaking rows and the first leaking instant."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for k in clocks:
        leak = c(k) > c(asof)
        aggs += [F.sum(ind(leak)).cast("bigint").alias(f"late_{k}"), F.min(F.when(leak, c(asof))).alias(f"first_{k}")]
    return df.agg(*aggs)


def assert_causal(df: DataFrame, asof: str, available: str) -> DataFrame:
    """The frame itself; the job fails on the first row that leaks."""
    ok = F.assert_true(c(available) <= c(asof), f"{available} is later than {asof}")
    return df.where(ok.isNull())


def audit(df: DataFrame, *, keys: Sequence[str], asof: str, order: Sequence[str], clocks: Sequence[str]) -> DataFrame:
    """One row: leaks per clock, steps back in time per key in arrival order, duplicate keys."""
    s = sequence(df, keys, order, back=1)
    d = s.add({"_back": F.lag(asof).over(s.by()) > c(asof)}).result()
    aggs = [F.sum(ind(c(k) > c(asof))).cast("bigint").alias(f"late_{k}") for k in clocks]
    one = d.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(ind(F.col("_back"))).cast("bigint").alias("steps_back"), *aggs)
    dup = df.groupBy(*keys, asof).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
    return one.withColumn("_g", F.lit(1)).join(dup.withColumn("_g", F.lit(1)), "_g").drop("_g")


def provenance_audit(df: DataFrame, asof: str, clock_of: dict[str, str]) -> DataFrame:
    """Per feature: rows where it is present but its declared clock is missing or later than ``asof``."""
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("clock"), c(f).isNotNull().alias("present"),
                     (c(f).isNotNull() & (c(k).isNull() | (c(k) > c(asof)))).alias("bad")) for f, k in clock_of.items()]
    d = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return d.groupBy("feature", "clock").agg(F.sum(ind(F.col("present"))).cast("bigint").alias("present"),
                                             F.sum(ind(F.col("bad"))).cast("bigint").alias("bad"))


def freeze_segment(clock: str, freeze: int) -> Column:
    return F.when(c(clock) < freeze, "backfill").otherwise("forward")


def event_id(*cols: str) -> Column:
    return row_hash(*cols)


def seal(df: DataFrame, cols: Sequence[str]) -> Column:
    """Digest of the row's content as JSON with its columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def unsealed_only(new: DataFrame, sealed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not sealed yet: what an append may write."""
    return new.join(sealed.select(*key), list(key), "left_anti")


def merge_planes(base: DataFrame, planes: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Left equi-joins on the plane key; a plane with a repeated key fails the job."""
    key = list(key)
    out = base
    for i, p in enumerate(planes):
        rest = [x for x in p.columns if x not in key]
        one = p.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_p"))
        ok = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"plane {i} repeats a key")).cast("string"))
        one = one.where(ok.isNull()).select(*key, *[F.col(f"_p.{x}").alias(x) for x in rest])
        out = out.join(one, key, "left")
    return out
