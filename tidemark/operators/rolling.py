"""Rolling statistics as columns over a blocked sequence (``blocks.Seq``).

Every function takes the sequence and returns a column. Frames are row frames; the
caller gives the sequence enough ``back`` rows. ``minp`` is the number of non-missing
values below which the result is missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clip, div, ind, safe_div
from tidemark.operators.blocks import Seq


def min_periods(n: int) -> int:
    """A third of the window, at least two values."""
    return 1 if n <= 1 else min(n, max(2, n // 3))


def gate(value: Column, x: Column, w, minp: int) -> Column:
    return F.when(F.count(x).over(w) >= minp, value)


def lag(s: Seq, x, k: int = 1) -> Column:
    return F.lag(c(x), k).over(s.by()) if k >= 0 else F.lead(c(x), -k).over(s.by())


def change(s: Seq, x, k: int = 1) -> Column:
    return c(x) - lag(s, x, k)


def pct_change(s: Seq, x, k: int = 1) -> Column:
    return div(x, lag(s, x, k)) - 1.0


def roll(s: Seq, agg, x, n: int, minp: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows, current row included."""
    w, x = s.rows(-(n - 1), 0), c(x)
    return gate(agg(x).over(w), x, w, n if minp is None else minp)


def prior(s: Seq, agg, x, n: int, minp: int | None = None) -> Column:
    """``agg`` over the ``n`` rows strictly before the current row."""
    w, x = s.rows(-n, -1), c(x)
    return gate(agg(x).over(w), x, w, n if minp is None else minp)


def ahead(s: Seq, agg, x, n: int, minp: int | None = None) -> Column:
    """``agg`` over the next ``n`` rows, current row excluded."""
    w, x = s.rows(1, n), c(x)
    return gate(agg(x).over(w), x, w, n if minp is None else minp)


def mean(s, x, n, minp=None):
    return roll(s, F.avg, x, n, minp)


def std(s, x, n, minp=None):
    return roll(s, F.stddev_samp, x, n, minp)


def total(s, x, n, minp=None):
    return roll(s, F.sum, x, n, minp)


def high(s, x, n, minp=None):
    return roll(s, F.max, x, n, minp)


def low(s, x, n, minp=None):
    return roll(s, F.min, x, n, minp)


def quantile(s, x, n, q, minp=None):
    return roll(s, lambda v: F.percentile(v, F.lit(q)), x, n, minp)


def prior_z(s, x, n, minp=None):
    """Distance from the mean of the n rows before, in their standard deviations."""
    return div(c(x) - prior(s, F.avg, x, n, minp), prior(s, F.stddev_samp, x, n, minp))


def z_full(s, x, n, minp=None, eps: float = 1e-12):
    return (c(x) - mean(s, x, n, minp)) / (std(s, x, n, minp) + eps)


def z_plain(s, x, n, minp=None):
    return div(c(x) - mean(s, x, n, minp), std(s, x, n, minp))


def z_safe(s, x, n):
    """z with missing results as 0, one value is enough for the mean."""
    return safe_div(c(x) - mean(s, x, n, 1), std(s, x, n, 1))


def rank_share(s, x, n):
    """Share of the last n values (current included) not above the current one."""
    w = s.rows(-(n - 1), 0)
    got = F.collect_list(c(x)).over(w)
    return div(F.size(F.filter(got, lambda v: v <= c(x))).cast("double"), F.count(F.lit(1)).over(w))


def prior_rank_share(s, x, n, minp=None):
    """Share of the n values strictly before that are not above the current one."""
    w, x = s.rows(-n, -1), c(x)
    got = F.collect_list(x).over(w)
    share = div(F.size(F.filter(got, lambda v: v <= x)).cast("double"), F.size(got))
    return F.when(x.isNotNull() & (F.size(got) >= (n if minp is None else minp)), share)


def slope(s, x, n, idx: str, minp=None):
    """Least-squares slope per row; ``idx`` is a column that grows by one per row."""
    w, x = s.rows(-(n - 1), 0), c(x)
    minp = min_periods(n) if minp is None else minp
    return gate(F.coalesce(F.regr_slope(x, F.when(x.isNotNull(), c(idx).cast("double"))).over(w), F.lit(0.0)), x, w, minp)


def r2(s, x, n, idx: str, minp=None):
    w, x = s.rows(-(n - 1), 0), c(x)
    minp = min_periods(n) if minp is None else minp
    raw = F.coalesce(F.regr_r2(x, c(idx).cast("double")).over(w), F.lit(0.0))
    flat = F.coalesce(F.var_pop(x).over(w), F.lit(0.0)) * F.count(x).over(w) <= 1e-12
    few = F.count(x).over(w) < 3
    return gate(F.when(flat | few, 0.0).otherwise(clip(raw, 0.0, 1.0)), x, w, minp)


def correlation(s, x, y, n, minp=None):
    w = s.rows(-(n - 1), 0)
    x, y = c(x), c(y)
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    vx = F.stddev_samp(F.when(y.isNotNull(), x)).over(w)
    vy = F.stddev_samp(F.when(x.isNotNull(), y)).over(w)
    ok = (F.count(both).over(w) >= (n if minp is None else minp)) & (vx > 1e-14) & (vy > 1e-14)
    return F.when(ok, F.corr(x, y).over(w))


def covariance(s, x, y, n, minp=None):
    w = s.rows(-(n - 1), 0)
    both = F.when(c(x).isNotNull() & c(y).isNotNull(), F.lit(1))
    return F.when(F.count(both).over(w) >= (n if minp is None else minp), F.covar_samp(c(x), c(y)).over(w))


def autocorrelation(s, x, lagged, n, minp=None):
    """Correlation of a value with ``lagged`` (its lag as a column) inside the window."""
    return F.coalesce(correlation(s, x, lagged, n, minp), F.lit(0.0))


def sign_entropy(s, x, n):
    """Entropy (nats) of the up / down / flat shares of the window."""
    w, sg = s.rows(-(n - 1), 0), F.signum(c(x))
    count = F.count(sg).over(w)
    out = F.lit(0.0)
    for v in (-1.0, 0.0, 1.0):
        p = div(F.sum(ind(sg == v)).over(w), count)
        out = out - F.when(p > 0, p * F.ln(p)).otherwise(0.0)
    return F.when(count >= n, out)


def direction_entropy(s, x, n):
    """Entropy of a histogram of the window's signs (-1, 0, 1) in max(2, rows // 2) bins, over the log of the bins used; -1 where one bin holds all, 0 for one row."""
    w, sg = s.rows(-(n - 1), 0), c(x)
    count = F.count(sg).over(w)
    down, flat, up = (F.sum(ind(sg == v)).over(w) for v in (-1.0, 0.0, 1.0))
    joined = (count < 6) & (down > 0) & (up > 0)  # two bins: the middle goes with the upper one
    parts = down, F.when(joined, F.lit(0.0)).otherwise(flat), F.when(joined, flat + up).otherwise(up)
    eps = F.lit(1e-12)
    total = sum((F.when(p > 0, p / count * F.ln(p / count + eps)).otherwise(0.0) for p in parts), F.lit(0.0))
    used = sum((F.when(p > 0, 1.0).otherwise(0.0) for p in parts), F.lit(0.0))
    return F.when(count >= 2, -total / F.ln(used + eps)).when(count == 1, F.lit(0.0))


def skewness(s, x, n):
    """Bias-corrected skewness over a full window, from the population form."""
    w, x = s.rows(-(n - 1), 0), c(x)
    k = F.count(x).over(w).cast("double")
    return gate(F.skewness(x).over(w) * F.try_divide(F.sqrt(k * (k - 1)), k - 2), x, w, n)


def kurtosis(s, x, n):
    """Bias-corrected excess kurtosis over a full window."""
    w, x = s.rows(-(n - 1), 0), c(x)
    k = F.count(x).over(w).cast("double")
    return gate(F.try_divide(k - 1, (k - 2) * (k - 3)) * ((k + 1) * F.kurtosis(x).over(w) + 6), x, w, n)


def sharpe(s, x, n, minp=None):
    return div(mean(s, x, n, minp), std(s, x, n, minp))


def side_vol_ratio(s, x, n, up: bool = True, minp: int = 2):
    """Standard deviation of one sign over that of the other."""
    w, x = s.rows(-(n - 1), 0), c(x)
    pos, neg = F.when(x > 0, x), F.when(x < 0, x)
    a, b = (pos, neg) if up else (neg, pos)
    ok = (F.count(a).over(w) >= minp) & (F.count(b).over(w) >= minp)
    return F.when(ok, div(F.stddev_samp(a).over(w), F.stddev_samp(b).over(w)))


def reversal_density(s, sign_changed, n):
    return mean(s, sign_changed, n, 1)


def vwap(s, price, volume, n):
    w = s.rows(-(n - 1), 0)
    return div(F.sum(c(price) * c(volume)).over(w), F.sum(c(volume)).over(w))


def prior_beta(s, y, x, n, minp=None):
    """cov/var over the n rows strictly before."""
    w = s.rows(-n, -1)
    y, x = c(y), c(x)
    both = y.isNotNull() & x.isNotNull()
    xx = F.when(both, x)
    ok = F.count(xx).over(w) >= (n if minp is None else minp)
    return F.when(ok, div(F.covar_samp(y, x).over(w), F.var_samp(xx).over(w)))


def two_factor_betas(s, y, x1, x2, n, minp) -> tuple[Column, Column]:
    """Slopes of y on two factors without intercept, from five sums over the n rows before."""
    w = s.rows(-n, -1)
    y, x1, x2 = c(y), c(x1), c(x2)
    ok = y.isNotNull() & x1.isNotNull() & x2.isNotNull()

    def t(e):
        return F.sum(F.when(ok, e)).over(w)

    a, b, d, p, q = t(x1 * x1), t(x1 * x2), t(x2 * x2), t(x1 * y), t(x2 * y)
    det = a * d - b * b
    good = (F.count(F.when(ok, 1)).over(w) >= minp) & (F.abs(det) > 1e-24)
    return F.when(good, F.try_divide(d * p - b * q, det)), F.when(good, F.try_divide(a * q - b * p, det))


def wma(s, x, n, minp=None):
    """Linearly weighted mean; short windows use the newest weights."""
    w, x = s.rows(-(n - 1), 0), c(x)
    got = F.collect_list(x).over(w)
    k = F.size(got)
    pairs = F.zip_with(got, F.sequence(F.lit(n) - k + 1, F.lit(n)), lambda v, i: v * i)
    top = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
    weight = k * (F.lit(n) - k + 1 + n) / 2.0
    return gate(F.try_divide(top, weight), x, w, min_periods(n) if minp is None else minp)


def max_drawdown(s, x, n):
    """Lowest price over running peak - 1 inside the window."""
    got = F.collect_list(c(x)).over(s.rows(-(n - 1), 0))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(a, v):
        peak = F.greatest(a["peak"], v)
        return F.struct(peak.alias("peak"), F.least(a["dd"], F.try_divide(v, peak) - 1.0).alias("dd"))

    return F.aggregate(got, start, step, lambda a: a["dd"])


def fractal_dimension(s, x, step_abs, n):
    """log n / (log n + log(net move / path)) clipped to [1, 2]; ``step_abs`` is |x - lag x|."""
    w, inner = s.rows(-(n - 1), 0), s.rows(-(n - 2), 0)
    k = F.count(c(x)).over(w).cast("double")
    path = F.sum(c(step_abs)).over(inner)
    net = F.abs(c(x) - F.first(c(x)).over(w))
    dim = clip(F.ln(k) / (F.ln(k) + F.ln(div(net, path) + 1e-12)), 1.0, 2.0)
    return F.when(k >= min(n, 5), F.when((net <= 1e-12) | (path <= 1e-12), 1.0).otherwise(dim))


def katz_dimension(s, x, step_abs, n):
    w, inner = s.rows(-(n - 1), 0), s.rows(-(n - 2), 0)
    k = F.count(c(x)).over(w).cast("double")
    path = F.sum(c(step_abs)).over(inner)
    start = F.first(c(x)).over(w)
    far = F.greatest(F.abs(F.max(c(x)).over(w) - start), F.abs(F.min(c(x)).over(w) - start))
    dim = clip(F.log10(k) / (F.log10(div(far, path) + 1e-12) + F.log10(k)), 1.0, 2.0)
    return F.when(k >= min(n, 5), F.when((far <= 1e-12) | (path <= 1e-12), 1.0).otherwise(dim))


def padded_list(s, x, n):
    """The last n values as an array, zeros where missing or before the start."""
    got = F.collect_list(F.coalesce(c(x).cast("double"), F.lit(0.0))).over(s.rows(-(n - 1), 0))
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(got)), got)


def padded_matrix(s, cols, n):
    """The last n rows of ``cols`` as an array of arrays, zero rows in front."""
    row = F.array(*[F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols])
    got = F.collect_list(row).over(s.rows(-(n - 1), 0))
    blank = F.array(*[F.lit(0.0) for _ in cols])
    return F.concat(F.array_repeat(blank, F.lit(n) - F.size(got)), got)


def permutation_code(s, x):
    """Which of the six orders the last three values form (ties in time order)."""
    x0, x1, x2 = lag(s, x, 2), lag(s, x, 1), c(x)
    code = (F.when(x0 <= x1, 0).otherwise(4) + F.when(x1 <= x2, 0).otherwise(2) + F.when(x0 <= x2, 0).otherwise(1))
    return F.when(x0.isNotNull() & x1.isNotNull() & x2.isNotNull(), code)


def permutation_entropy(s, code, n):
    """Entropy of the order-3 patterns inside the window, over log 6."""
    w = s.rows(-(n - 3), 0)
    count = F.count(c(code)).over(w)
    out = F.lit(0.0)
    for k in range(8):
        p = div(F.sum(ind(c(code) == k)).over(w), count)
        out = out - F.when(p > 0, p * F.ln(p + 1e-12)).otherwise(0.0)
    return F.when(count >= min(n, 4) - 2, out / math.log(6.0))
