"""Values that depend on the value before: smoothing, runs, state machines.

A smoother's step is affine in its state, so a block of rows is an affine map too: where a key has several blocks, each
reports its map, the maps are folded in order, and every block then starts from the state that one scan of the whole key
has there, after however many missing values. A smoother of a smoother takes one such pass more for each level.
Runs and states use gaps-and-islands over windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import c, clean
from tidemark.operators.asof import asof_join
from tidemark.operators.blocks import BLK, BLOCK_ROWS, RN, TB, Seq, carried, cut, number_rows, running_total, sequence
from tidemark.session import pin

EPS = 1e-12


def warmup(span: float, depth: int = 1) -> int:
    """Rows copied in front of a block for kernels of this span: twice what their bounded windows look at."""
    return int(20 * (span + 1) * (1 + 0.35 * (depth - 1))) + 10


class Carry:
    """The smoothers of one block in the order in which they are called: their states at the start, and their maps.

    ``start`` to ``stop`` are the rows whose map is reported; outputs begin at ``start``. A state is (value, rows since,
    weight, count), a map (kind, rate, rows, first, value there, rate there, end, factor, rows since, sum, weight, count).
    """

    now: Carry | None = None

    def __init__(self, start: int, stop: int, states: np.ndarray):
        self.start, self.stop, self.states, self.maps = start, stop, states, []

    def state(self) -> np.ndarray:
        k = len(self.maps)
        return self.states[k] if k < len(self.states) else np.array([np.nan, 0.0, 0.0, 0.0])

    def placed(self, x: pd.Series, values: np.ndarray) -> pd.Series:
        out = np.full(len(x), np.nan)
        out[self.start:] = values
        return pd.Series(out, index=x.index)

    def ewm(self, x: pd.Series, alpha: float) -> pd.Series:
        value, since, _, _ = self.state()
        v = x.to_numpy(dtype="float64")[self.start:]
        part = v[:self.stop - self.start]
        have = np.flatnonzero(~np.isnan(part))
        if len(have):
            own = pd.Series(part[have[0]:]).ewm(alpha=alpha, adjust=False).mean().to_numpy()
            w = (1.0 - alpha) ** np.diff(have).astype("float64")
            self.maps.append([0, alpha, len(part), have[0], part[have[0]], alpha, own[-1], np.prod(w / (w + alpha)), len(part) - 1 - have[-1], 0, 0, 0])
        else:
            self.maps.append([0, alpha, len(part), -1, 0, 0, 0, 0, 0, 0, 0, 0])
        if np.isnan(value):
            return self.placed(x, pd.Series(v).ewm(alpha=alpha, adjust=False).mean().to_numpy())
        gap = int(min(since, 750 / alpha))  # beyond that the weight is 0
        led = np.concatenate([[value], np.full(gap, np.nan), v])
        return self.placed(x, pd.Series(led).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1 + gap:])

    def adjusted(self, x: pd.Series, alpha: float, least: int) -> pd.Series:
        total, _, weight, count = self.state()
        total = 0.0 if np.isnan(total) else total
        v = x.to_numpy(dtype="float64")[self.start:]
        have = ~np.isnan(v)
        fade = (1.0 - alpha) ** np.arange(1, len(v) + 1)
        mean = pd.Series(v).ewm(alpha=alpha).mean().fillna(0.0).to_numpy()
        w = pd.Series(have.astype("float64")).ewm(alpha=alpha).mean().to_numpy() * (1.0 - fade) / alpha if len(v) else np.zeros(0)
        k = self.stop - self.start
        self.maps.append([2, alpha, k, -1, 0, 0, 0, 0, 0, mean[k - 1] * w[k - 1] if k else 0, w[k - 1] if k else 0, have[:k].sum()])
        all_w = w + fade * weight
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(have.cumsum() + count >= least, (mean * w + fade * total) / all_w, np.nan)
        return self.placed(x, out)

    def adaptive(self, x: pd.Series, rates: np.ndarray) -> pd.Series:
        value = self.state()[0]
        v, r = x.to_numpy(dtype="float64")[self.start:], rates[self.start:]
        k = self.stop - self.start
        have = np.flatnonzero(~np.isnan(v[:k]))
        if len(have):
            f = have[0]
            self.maps.append([1, 0, k, f, v[f], r[f], follow(v[f:k], r[f:k], np.nan)[-1], np.prod(1.0 - r[have[1:]]), 0, 0, 0, 0])
        else:
            self.maps.append([1, 0, k, -1, 0, 0, 0, 0, 0, 0, 0, 0])
        return self.placed(x, follow(v, r, value))


def carried_states(maps: list[np.ndarray]) -> list[np.ndarray]:
    """The states at the start of each block, from the blocks' maps in order."""
    state = np.tile([np.nan, 0.0, 0.0, 0.0], (len(maps[0]), 1))
    out = []
    for block in maps:
        out.append(state)
        state = state.copy()
        for s, (kind, rate, rows, first, x, r, end, factor, since, total, weight, count) in zip(state, block, strict=True):
            if kind == 2:
                fade = (1.0 - rate) ** rows
                s[:] = (0.0 if np.isnan(s[0]) else s[0]) * fade + total, 0.0, s[2] * fade + weight, s[3] + count
            elif first < 0:
                s[1] += rows
            else:
                w = (1.0 - rate) ** (s[1] + first + 1) if kind == 0 else 1.0 - r
                begin = x if np.isnan(s[0]) else (w * s[0] + r * x) / (w + r)
                s[0], s[1] = end + factor * (begin - x), since
    return out


def follow(values: np.ndarray, rates: np.ndarray, last: float) -> np.ndarray:
    """last + rate * (value - last), step by step over the values that are there."""
    out = np.empty(len(values))
    for i in range(len(values)):
        v = values[i]
        if v == v:
            last = v if last != last else last + rates[i] * (v - last)
        out[i] = last
    return out


def ewm(x: pd.Series, alpha: float) -> pd.Series:
    return Carry.now.ewm(x, alpha) if Carry.now else x.ewm(alpha=alpha, adjust=False).mean()


def levels(depth: int):
    """Marks a kernel with how many smoothers feed one another in it."""
    def mark(fn):
        fn.depth = depth
        return fn

    return mark


def kernel_pass(s: Seq, outputs: dict[str, tuple[Callable, Sequence[str]]]) -> Seq:
    """Add one double column per entry: ``fn(*columns)`` on the block's ordered values.

    All recurrences of a feature set go through one Arrow pass; a group is one block. Where keys have several blocks,
    the states of the smoothers are carried between them first, one pass for each level. A kernel's bounded windows may
    look at half of the rows copied in front of a block.
    """
    keep = s.df.columns
    schema = T.StructType(list(s.df.schema.fields) + [T.StructField(k, T.DoubleType()) for k in outputs])
    order, keys, size, half = list(s.order), list(s.keys), s.size, s.back // 2
    work = dict(outputs)

    def kernels(pdf: pd.DataFrame, states: np.ndarray | None):
        pdf = pdf.sort_values(order, kind="stable")
        if states is not None:
            block = int(pdf[BLK].iloc[0])
            start, stop = np.searchsorted(pdf[RN].to_numpy(), [max(0, block * size - half), (block + 1) * size - half])
            Carry.now = Carry(int(start), int(stop), states)
        try:
            found = {name: np.asarray(fn(*[pdf[x].astype("float64") for x in cols]), dtype="float64") for name, (fn, cols) in work.items()}
            return pdf.assign(**found), Carry.now
        finally:
            Carry.now = None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernels(pdf, None)[0]

    passes = 0 if s.single else max(getattr(fn, "depth", 0) for fn, _ in work.values())
    if not passes:
        out = s.df.groupBy(*keys, BLK).applyInPandas(run, schema)
        return replace(s, df=out.select(*keep, *[clean(k).alias(k) for k in outputs]))

    rows = pin(s.df)
    ids = T.StructType([rows.schema[k] for k in (*keys, BLK)])
    small = T.StructType([*ids.fields, T.StructField("carry_", T.BinaryType())])
    unpack = lambda b: np.frombuffer(b, dtype="float64")

    def report(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        maps = kernels(pdf, unpack(known["carry_"].iloc[0]).reshape(-1, 4))[1].maps
        return pdf[[*keys, BLK]].head(1).assign(carry_=[np.array(maps, dtype="float64").tobytes()])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLK)
        return pdf.assign(carry_=[x.tobytes() for x in carried_states([unpack(b).reshape(-1, 12) for b in pdf["carry_"]])])

    def finish(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return kernels(pdf, unpack(known["carry_"].iloc[0]).reshape(-1, 4))[0]

    both = lambda states: rows.groupBy(*keys, BLK).cogroup(states.groupBy(*keys, BLK))
    states = rows.select(*keys, BLK).distinct().withColumn("carry_", F.lit(b""))
    for _ in range(passes):
        maps = both(states).applyInPandas(report, small)
        if keys:
            states = pin(maps.groupBy(*keys).applyInPandas(fold, small))  # one row for each block of a key
        else:
            states = pin(maps.groupBy(F.lit(0)).applyInPandas(fold, small))
    out = both(states).applyInPandas(finish, schema)
    return replace(s, df=out.select(*keep, *[clean(k).alias(k) for k in outputs]))


def smooth(df: DataFrame, keys, order, outputs, back: int, size: int = 250_000) -> DataFrame:
    """``kernel_pass`` on a plain frame."""
    return kernel_pass(sequence(df, keys, order, back=back, size=size), outputs).result()


# --- kernels: pandas series in, array out ---------------------------------------------------

def ema(span: float):
    return levels(1)(lambda x: ewm(x, 2.0 / (max(span, 1) + 1)))


def ewm_com(com: float):
    return levels(1)(lambda x: ewm(x, 1.0 / (1.0 + com)))


def ewm_alpha(alpha: float):
    return levels(1)(lambda x: ewm(x, alpha))


def ewm_adjusted(span: int):
    """Weighted mean normalised by the weights so far; missing until ``span`` values."""
    return levels(1)(lambda x: Carry.now.adjusted(x, 2.0 / (span + 1), span) if Carry.now else x.ewm(span=span, min_periods=span).mean())


def dema(span: int):
    e = ema(span)

    def fn(x):
        a = e(x)
        return 2 * a - e(a)

    return levels(2)(fn)


def tema(span: int):
    e = ema(span)

    def fn(x):
        a = e(x)
        b = e(a)
        return 3 * a - 3 * b + e(b)

    return levels(3)(fn)


def rsi(n: int, eps: float = EPS):
    s = ewm_com(max(n - 1, 1))

    def fn(x):
        d = x.diff()
        ratio = (s(d.clip(lower=0)) / (s(-d.clip(upper=0)) + eps)).fillna(0.0)
        return 100.0 - 100.0 / (1.0 + ratio)

    return levels(1)(fn)


def kama(n: int, fast: int = 2, slow: int = 30):
    quick, lazy = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def fn(x):
        move = (x - x.shift(n)).abs()
        path = x.diff().abs().rolling(n, min_periods=1).sum()
        rate = ((move / (path + EPS)).fillna(0.0) * (quick - lazy) + lazy) ** 2
        return Carry.now.adaptive(x, rate.to_numpy()) if Carry.now else follow(x.to_numpy(), rate.to_numpy(), np.nan)

    return levels(1)(fn)


def true_range(h, l, cl):
    p = cl.shift(1)
    return pd.concat([(h - l).abs(), (h - p).abs(), (l - p).abs()], axis=1).max(axis=1)


def atr(span: int):
    return levels(1)(lambda h, l, cl: ema(span)(true_range(h, l, cl)))


def directional(n: int, part: str):
    """Directional movement: ``plus``, ``minus`` or ``adx``."""
    s = ewm_alpha(1.0 / max(n, 1))

    def fn(h, l, cl):
        up, down = h.diff(), -l.diff()
        tr = s(true_range(h, l, cl))
        plus = 100 * (s(up.where((up > down) & (up > 0), 0.0)) / (tr + EPS)).fillna(0.0)
        minus = 100 * (s(down.where((down > up) & (down > 0), 0.0)) / (tr + EPS)).fillna(0.0)
        if part == "plus":
            return plus
        if part == "minus":
            return minus
        return s(100 * ((plus - minus).abs() / (plus + minus + EPS)).fillna(0.0))

    return levels(2)(fn)


def tsi(n: int):
    slow, fast = ema(max(3, 2 * n)), ema(max(2, n))

    def fn(x):
        m = x.diff()
        return 100 * (fast(slow(m)) / (fast(slow(m.abs())) + EPS)).fillna(0.0)

    return levels(2)(fn)


def trix(n: int):
    e = ema(n)
    return levels(3)(lambda x: e(e(e(x))).pct_change(fill_method=None) * 100.0)


def ewma_vol(span: int, per_year: float):
    def fn(x):
        r = np.log(x / x.shift(1))
        return np.sqrt(ema(span)(r ** 2) * per_year)

    return levels(1)(fn)


def prior_rank(n: int, minp: int):
    """Share of the n values before that are not above the current one, for wide windows."""
    def fn(x):
        got = x.rolling(n + 1, min_periods=minp + 1).rank(method="max") - 1
        return got / (x.rolling(n + 1, min_periods=1).count() - 1)

    return fn


def _windows(x: pd.Series, n: int, minp: int, fn: Callable) -> np.ndarray:
    return x.rolling(n, min_periods=minp).apply(fn, raw=True).to_numpy()


def _share_entropy(weights: np.ndarray, size: int) -> float:
    p = weights[weights > 0] / max(weights.sum(), EPS)
    return float(-(p * np.log(p + EPS)).sum() / np.log(size + EPS))


def histogram_entropy(n: int):
    def one(a):
        a = a[np.isfinite(a)]
        if len(a) < 2:
            return 0.0
        counts = np.histogram(a, bins=min(10, max(2, len(a) // 2)))[0].astype(float)
        return _share_entropy(counts, int((counts > 0).sum()))

    return lambda x: _windows(x, n, 1, one)


def hurst(n: int):
    """Twice the slope of log sqrt(std of lagged differences) on log lag, in [0, 1]."""
    def one(a):
        a = a[np.isfinite(a)]
        lags = np.arange(2, min(20, len(a) // 2) + 1)
        if len(a) < 10 or len(lags) < 2:
            return 0.5
        tau = np.array([np.sqrt((a[k:] - a[:-k]).std()) for k in lags])
        ok = tau > 0
        if ok.sum() < 2:
            return 0.5
        return float(np.clip(2 * np.polyfit(np.log(lags[ok]), np.log(tau[ok]), 1)[0], 0, 1))

    return lambda x: _windows(x, n, min(n, 10), one)


def rescaled_range(n: int):
    """Range of the cumulated deviations over the standard deviation, as log R/S over log n."""
    def one(a):
        d = np.diff(a)
        sd = d.std()
        if len(d) < 4 or sd <= EPS:
            return 0.5
        walk = (d - d.mean()).cumsum()
        return float(np.clip(np.log((walk.max() - walk.min()) / sd + EPS) / np.log(len(d)), 0, 1))

    return lambda x: _windows(x, n, n, one)


def spectrum(n: int, what: str, component: int = 1):
    """``cycle`` length, ``entropy`` of the power, or the amplitude of one ``component``."""
    def one(a):
        a = a[np.isfinite(a)]
        need = component + 2 if what == "component" else 8
        if len(a) < need:
            return 0.0
        amp = np.abs(np.fft.rfft(a - a.mean()))
        if what == "component":
            return float(amp[component] / len(a))
        if what == "cycle":
            return float(len(a) / (np.argmax(amp[1:]) + 1)) if len(amp) > 2 else 0.0
        power = amp[1:] ** 2
        return 0.0 if power.sum() <= EPS else _share_entropy(power, len(power))

    return lambda x: _windows(x, n, min(n, 8), one)


# --- runs and states as windows ----------------------------------------------------------------

def add_run_lengths(df: DataFrame, keys, order, conditions: dict[str, Column], width: int) -> DataFrame:
    """Rows since each condition was last untrue (0 where untrue), over keys of any size.

    The place of the newest untrue row is carried across blocks as a running maximum.
    """
    keys = list(keys)
    d = number_rows(df, keys, order, width).withColumnRenamed(RN, "_place")
    d = d.withColumns({f"_no_{k}": F.when(F.coalesce(v, F.lit(False)), None).otherwise(F.col("_place")) for k, v in conditions.items()})
    d, blocks = cut(d, keys, "_place", BLOCK_ROWS)
    ends = d.groupBy(*keys, TB).agg(*[F.max(f"_no_{k}").alias(f"_b_{k}") for k in conditions])
    ends = carried(blocks, ends, keys, F.max, [f"_b_{k}" for k in conditions])
    w = Window.partitionBy(*keys, TB).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(ends, [*keys, TB])
    d = d.withColumns({k: (F.col("_place") - F.coalesce(F.max(f"_no_{k}").over(w), F.col(f"_b_{k}"), F.lit(-1))).cast("bigint")
                       for k in conditions})
    return d.select(*df.columns, *conditions)


def running_peak(df: DataFrame, keys, order, x: str, out: str, width: int) -> DataFrame:
    """Largest value so far in the key's history, carried across blocks."""
    keys, order = list(keys), list(order)
    d, blocks = cut(df, keys, order[0], width)
    ends = carried(blocks, d.groupBy(*keys, TB).agg(F.max(x).alias("_b")), keys, F.max, ["_b"])
    w = Window.partitionBy(*keys, TB).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(ends, [*keys, TB]).withColumn(out, F.greatest(F.max(x).over(w), F.col("_b")))
    return d.select(*df.columns, out)


def sign_run(df: DataFrame, keys, order, x: str, out: str, width: int) -> DataFrame:
    """Length of the current run of one sign; 0 where the value is 0 or missing."""
    sg = F.signum(F.coalesce(c(x), F.lit(0.0)))
    s = sequence(df, keys, order, back=1)
    d = s.add({"_sg": sg}).add({"_same": F.coalesce((F.lag("_sg").over(s.by()) == F.col("_sg")) & (F.col("_sg") != 0), F.lit(False))}).result()
    d = add_run_lengths(d, keys, order, {"_run": F.col("_same")}, width)
    return d.withColumn(out, F.when(F.col("_sg") == 0, F.lit(0)).otherwise(F.col("_run") + 1)).select(*df.columns, out)


def hysteresis(df: DataFrame, keys, order, x: str, out: str, enter: float, leave: float, width: int) -> DataFrame:
    """Sign held from |x| >= enter until |x| < leave.

    Stretches between two resets are numbered by a carried count; the first entry of a
    stretch is an aggregate, so no stretch is ever gathered in one task.
    """
    keys, order = list(keys), list(order)
    size = F.abs(c(x))
    d = running_total(df, keys, order, {"_isle": F.when(size < leave, 1).otherwise(0)}, width)
    first = d.where(size >= enter).groupBy(*keys, "_isle").agg(
        F.min_by(F.signum(c(x)), F.struct(*order)).alias("_sg"), F.min(F.struct(*order)).alias("_at"))
    d = d.join(first, [*keys, "_isle"], "left")
    held = F.when(F.struct(*order) >= F.col("_at"), F.col("_sg")).otherwise(0.0)
    return d.select(*df.columns, F.coalesce(held, F.lit(0.0)).alias(out))


def confirmed_state(df: DataFrame, keys, order, target: str, out: str, confirm: int, width: int, start: str) -> DataFrame:
    """A state that follows ``target`` only after ``confirm`` equal targets in a row.

    A target run of that length sets the state from its confirming row on; the state
    in between is the newest confirmed one, carried across blocks by an as-of join.
    """
    keys, order = list(keys), list(order)
    s = sequence(df, keys, order, back=1)
    d = s.add({"_same": F.coalesce(F.lag(target).over(s.by()) == F.col(target), F.lit(False))}).result()
    d = add_run_lengths(d, keys, order, {"_run": F.col("_same")}, width)
    sets = d.where(F.col("_run") == confirm - 1).select(*keys, F.col(order[0]).alias("_set_at"), F.col(target).alias("_set"))
    d = asof_join(d.drop("_same", "_run"), sets, by=keys, left_clock=order[0], right_clock="_set_at", cols=["_set"], prefix="n", width=width)
    return d.withColumn(out, F.coalesce("n_set", F.lit(start))).select(*df.columns, out)
