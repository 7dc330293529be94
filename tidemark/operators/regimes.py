"""Majority votes, crosses, cadences, calendar folds and checks of weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clip, ind
from tidemark.operators import recurrence as K
from tidemark.operators.blocks import RN, Seq, number_rows, running_total, sequence


def majority_vote(s: Seq, bear: Column, bull: Column, window: int = 24, least: int = 12, share: float = 0.60) -> Column:
    """BEAR, BULL or NEUTRAL by the share of recent rows that say so; BEAR comes first. Unknown rows say neither."""
    w = s.rows(-(window - 1), 0)
    vote = lambda x: F.when(F.count(F.lit(1)).over(w) >= least, F.avg(ind(F.coalesce(x, F.lit(False)))).over(w))
    return F.when(vote(bear) > share, "BEAR").when(vote(bull) > share, "BULL").otherwise("NEUTRAL")


def since_cross(df: DataFrame, keys: Sequence[str], order: Sequence[str], spread: str, width: int, fresh: int = 168) -> DataFrame:
    """Rows since ``spread`` last rose from 0 or below to above it (0 where it is not above, or never crossed), and whether that is at most ``fresh``.

    A stretch above that began with the key's first row has no cross.
    """
    d = K.add_run_lengths(df, keys, order, {"_run": c(spread) > 0}, width)
    d = number_rows(d, keys, order, width)
    days = F.when((c(spread) > 0) & (c("_run") <= c(RN)), c("_run") - 1)
    return d.select(*df.columns, F.coalesce(days, F.lit(0)).cast("double").alias("days_since_golden_cross"), F.when(days.isNotNull() & (days <= fresh), 1.0).otherwise(0.0).alias("gc_fresh"))


def atr_distance(distance: Column, close: Column, atr: Column, most: float = 15.0) -> Column:
    """A relative distance in units of the true range, within +-``most``; without a range one percent of the price stands for it."""
    return F.coalesce(clip(distance * close / F.when(atr > 0, atr).otherwise(close * 0.01), -most, most), F.lit(0.0))


def cadence_regimes(df: DataFrame, keys: Sequence[str], clock: str, unit: int, width: int) -> DataFrame:
    """(keys, start, end, cadence, n): stretches of rows whose gaps round to the same number of units. Neighbours share their border row."""
    keys = list(keys)
    s = sequence(df.select(*keys, clock), keys, [clock], ahead=1, back=1)
    s = s.add({"_next": F.lead(clock).over(s.by())})
    s = s.add({"cadence": F.bround((c("_next") - c(clock)) / unit).cast("bigint")})
    d = s.add({"_new": ind(F.coalesce(c("cadence") != F.lag("cadence").over(s.by()), F.lit(True))).cast("int")}).result().where("cadence IS NOT NULL")
    d = running_total(d, keys, [clock], {"_isle": F.col("_new")}, width)
    return d.groupBy(*keys, "_isle").agg(F.min(clock).alias("start"), F.max("_next").alias("end"), F.first("cadence").alias("cadence"), (F.count(F.lit(1)) + 1).alias("n")).drop("_isle")


def month_folds(df: DataFrame, stamp: str, fit_months: int = 24, calib_days: int = 120, embargo_hours: int = 8) -> DataFrame:
    """Each row once for every test month it serves: ``test_month`` and ``role`` (fit, calib_fit, calib_select or test).

    Calibration ends ``embargo_hours`` before the month and is halved by time; fitting ends where it begins.
    """
    ahead = fit_months + calib_days // 28 + 2
    month = F.trunc(F.col(stamp).cast("date"), "month")
    d = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(ahead)))).withColumn("_start", F.add_months(month, F.col("_k")))
    test = F.col("_start").cast("timestamp")
    calib = F.date_sub("_start", calib_days)
    fit = F.add_months(calib, -fit_months).cast("timestamp")
    us, calib = (lambda x: F.unix_micros(x)), calib.cast("timestamp")
    edge = us(test) - embargo_hours * 3_600_000_000
    middle, t = us(calib) + F.floor((edge - us(calib)) / 2), us(F.col(stamp).cast("timestamp"))
    role = F.when(F.col("_k") == 0, "test").when((t >= us(fit)) & (t < us(calib)), "fit").when((t >= us(calib)) & (t < middle), "calib_fit").when((t >= middle) & (t < edge), "calib_select")
    return d.withColumn("role", role).where("role IS NOT NULL").withColumn("test_month", F.date_format("_start", "yyyy-MM")).drop("_k", "_start")


def edge_retention(expected: Column, basis: Column, gross: Column, excess: Column) -> Column:
    """The forward result over the expected one, of the measure that ``basis`` names; missing without a basis or a positive expectation."""
    forward = F.when(basis == "ABSOLUTE", gross).when(basis == "EXCESS_VS_BASELINE", excess)
    return F.when(expected > 0, F.round(forward / expected, 3))


def weight_violations(weights: DataFrame, at: str, weight: str, beta: str, hedge: str, ret: str, cap: float) -> DataFrame:
    """One row: instants whose weights break a rule. ``hedge`` and ``ret`` are per instant and repeat on its rows."""
    d = weights.groupBy(at).agg(F.sum(F.abs(weight)).alias("gross"), F.max(F.abs(weight)).alias("top"), F.sum(weight).alias("net"), (F.sum(c(weight) * F.coalesce(beta, F.lit(0.0))) + F.first(hedge)).alias("beta"), F.first(ret).alias("ret"))
    count = lambda bad: F.count(F.when(bad, 1))
    return d.agg(F.count(F.lit(1)).alias("n"), count(c("gross") > 2.0 + 1e-6).alias("gross_leg_exceeds_2"), count(c("top") > cap + 1e-9).alias("per_name_cap_violated"), count(F.abs("net") > 1e-6).alias("long_short_not_dollar_neutral"),
                 count(F.abs("beta") > 0.05).alias("portfolio_beta_not_neutral"), count(c("ret") <= -1.0).alias("daily_return_leq_minus_100pct"))
