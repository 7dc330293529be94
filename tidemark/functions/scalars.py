"""Scalar column helpers: safe arithmetic, clocks, hashes and the normal law."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: str | Column) -> Column:
    """NaN and infinities become null: missing is null everywhere in this library."""
    x = c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def div(a: str | Column, b: str | Column) -> Column:
    """a/b, null where b is 0 or either is missing."""
    return F.try_divide(c(a), c(b))


def safe_div(a: str | Column, b: str | Column, default: float = 0.0, eps: float = EPS) -> Column:
    """a/(b+eps) with missing and infinite results replaced by ``default``."""
    return F.coalesce(clean(F.try_divide(c(a), c(b) + F.lit(eps))), F.lit(default))


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounded value; a missing value stays missing."""
    x = c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def flag(cond: Column) -> Column:
    """1.0 where true, else 0.0 (unknown counts as not true)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def ind(cond: Column, value: Column | None = None) -> Column:
    """``value`` where true, else 0 (used inside sums)."""
    return F.when(cond, value if value is not None else F.lit(1.0)).otherwise(F.lit(0.0))


def epoch_us(ts: str | Column) -> Column:
    return F.unix_micros(c(ts).cast("timestamp"))


def floor_to(clock: str | Column, width: int) -> Column:
    return c(clock) - F.pmod(c(clock), F.lit(width))


def row_hash(*cols: str | Column, sep: str = "|") -> Column:
    """SHA-256 of the text forms of ``cols``; a missing value is the word null."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(c(x).cast("string"), F.lit("null")) for x in cols]), 256)


def draw(seed: int, *cols: str | Column) -> Column:
    """A repeatable whole number in [0, 2**32) per row: the head of a digest of the seed and ``cols``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c(x).cast("string") for x in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *cols: str | Column) -> Column:
    return draw(seed, *cols) / F.lit(4294967296.0)


# Coefficients of the rational approximation of the inverse normal law.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
      1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
      6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for k in coefs[1:]:
        out = out * x + F.lit(k)
    return out


def normal_quantile(p: str | Column) -> Column:
    """z with P(Z <= z) = p; null outside (0, 1)."""
    p = c(p)
    low = 0.02425
    q = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
    tail = _poly(_C, q) / (_poly(_D, q) * q + 1.0)
    m = p - 0.5
    r = m * m
    mid = _poly(_A, r) * m / (_poly(_B, r) * r + 1.0)
    return (F.when((p <= 0) | (p >= 1), None).when(p < low, tail).when(p > 1 - low, -tail).otherwise(mid))


# Coefficients of the rational approximation of the error function (error below 1.5e-7).
_ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def erfc(x: str | Column) -> Column:
    """Complementary error function by a rational approximation (absolute error below 1.5e-7)."""
    x = c(x)
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    tail = _poly(_ERF, t) * t * F.exp(-x * x)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_cdf(z: str | Column) -> Column:
    return 0.5 * erfc(-c(z) / math.sqrt(2.0))
