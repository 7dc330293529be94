"""Tests over many configurations and replicates: grid placebo, path bootstraps, rank duplicates, least squares from sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, draw, ind
from tidemark.operators.blocks import RN, number_rows
from tidemark.session import pin

# Multipliers and modulus of the counter-based shuffle keys (both engines compute them in whole numbers).
SHUFFLE = (48271, 69621, 2147483647)


# --- grid placebo --------------------------------------------------------------------------------


def shuffle_keys(reps: int, day: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key for each (day, replicate, name): names in order of their keys are the day's permutation."""
    a, b, m = SHUFFLE
    rep = np.arange(reps)[None, :, None]
    u = (rep * 1000003 + day[:, None, None] * 7919 + place[None, None, :] * 104729 + 1) % m
    return ((u * a) % m * b + place[None, None, :] * 31 + rep * 17) % m


class Path:
    """Mergeable sums of many series over a stretch of days: enough for means and autocovariances up to ``lag``.

    Row i of ``x`` is a day, the columns are series. Two stretches merge by the products across their border, which the
    first and last ``lag`` days of each hold.
    """

    def __init__(self, x: np.ndarray, lag: int):
        self.lag, self.n, self.total = lag, len(x), x.sum(axis=0)
        self.cross = np.stack([(x[k:] * x[:len(x) - k]).sum(axis=0) if k <= len(x) else np.zeros(x.shape[1]) for k in range(lag + 1)])
        self.head, self.tail = x[:lag], x[max(len(x) - lag, 0):]

    def then(self, other: Path) -> Path:
        out = object.__new__(Path)
        out.lag, out.n, out.total, out.cross = self.lag, self.n + other.n, self.total + other.total, self.cross + other.cross
        for k in range(1, self.lag + 1):
            for j in range(min(k, len(other.head))):
                i = len(self.tail) + j - k
                if i >= 0:
                    out.cross[k] += self.tail[i] * other.head[j]
        out.head = self.head if len(self.head) == self.lag else np.concatenate([self.head, other.head])[:self.lag]
        out.tail = other.tail if len(other.tail) == self.lag else np.concatenate([self.tail, other.tail])[-self.lag:] if self.lag else other.tail
        return out

    def t(self) -> np.ndarray:
        """Mean over its Newey-West standard error."""
        mean = self.total / self.n
        first, last = self.head, self.tail[::-1]
        s = self.cross[0] / self.n - mean ** 2
        for k in range(1, min(self.lag, self.n - 1) + 1):
            late, early = self.total - first[:k].sum(axis=0), self.total - last[:k].sum(axis=0)
            s = s + 2.0 * (1.0 - k / (self.lag + 1.0)) * (self.cross[k] - mean * (late + early) + (self.n - k) * mean ** 2) / self.n
        return mean / np.sqrt(np.maximum(s, 1e-18) / self.n)


def grid_placebo(df: DataFrame, *, at: str, place: str, ret: str, cost: str, weights: str, ok: str, lags: Sequence[int], reps: int, least: Sequence[int], block: int = 64) -> DataFrame:
    """(rep, max_t): the largest t of a whole grid of configurations under returns permuted between the names of each day.

    ``df`` has a row for each day and name: ``weights`` and ``ok`` are arrays with one value a configuration (the weight
    in force, and whether the day counts), ``place`` numbers the names. Only the returns that are there are permuted, so
    weights, masks and costs hold for every replicate. Each block of days multiplies its weights with its permuted
    returns and keeps sums; blocks of a configuration merge in order. Of the two directions the one with the larger mean
    counts. A configuration with fewer than ``least`` days is left out.
    """
    lags, least = list(lags), list(least)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        days, d = np.unique(pdf["at"], return_inverse=True)
        names, p = np.unique(pdf["place"], return_inverse=True)
        w = np.zeros((len(days), len(lags), len(names)))
        mask = np.zeros((len(days), len(lags)), bool)
        r, k = np.full((len(days), len(names)), np.nan), np.zeros((len(days), len(names)))
        w[d, :, p] = np.stack(pdf["weights"].to_numpy())
        mask[d] = np.stack(pdf["ok"].to_numpy())
        r[d, p], k[d, p] = pdf["ret"], pdf["cost"]
        have = np.isfinite(r)
        keys = np.where(have[:, None, :], shuffle_keys(reps, days, names), np.iinfo(np.int64).max)
        source = np.argsort(np.where(have, names[None, :], np.iinfo(np.int64).max), axis=1, kind="stable")
        target = np.argsort(keys, axis=2, kind="stable")
        mixed = np.zeros((len(days), reps, len(names)))
        np.put_along_axis(mixed, target, np.take_along_axis(np.nan_to_num(r), source, axis=1)[:, None, :].repeat(reps, axis=1), axis=2)
        gross = np.einsum("dcn,drn->dcr", w, mixed) * 1e4
        spent = pdf.assign(d=d)
        paid = np.zeros((len(days), len(lags)))
        np.add.at(paid, spent["d"].to_numpy(), np.stack(pdf["paid"].to_numpy()))
        rows = []
        for i, lag in enumerate(lags):
            on = mask[:, i]
            x = np.concatenate([gross[on, i] - paid[on, i, None], -gross[on, i] - paid[on, i, None]], axis=1)
            path = Path(x, lag)
            rows.append((i, int(pdf["block"].iloc[0]), path.n, path.total.tobytes(), path.cross.tobytes(), path.head.tobytes(), path.tail.tobytes()))
        return pd.DataFrame(rows, columns=["config", "block", "n", "total", "cross_", "head", "tail"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, i = None, int(pdf["config"].iloc[0])
        for r in pdf.sort_values("block").itertuples():
            path = object.__new__(Path)
            path.lag, path.n = lags[i], r.n
            path.total, path.cross, path.head, path.tail = (np.frombuffer(b).reshape(-1, 2 * reps).copy() for b in (r.total, r.cross_, r.head, r.tail))
            path.total = path.total[0]
            whole = path if whole is None else whole.then(path)
        if whole.n < least[i]:
            return pd.DataFrame({"rep": [], "t": []})
        mean, t = whole.total / whole.n, whole.t()
        best = np.where(mean[reps:] > mean[:reps], t[reps:], t[:reps])
        return pd.DataFrame({"rep": np.arange(reps), "t": best})

    rows = df.select(c(at).alias("at"), c(place).cast("bigint").alias("place"), c(ret).alias("ret"), F.lit(0.0).alias("cost"), c(weights).alias("weights"), c(ok).alias("ok"), c(cost).alias("paid"), F.floor(c(at) / block).alias("block"))
    sums = rows.groupBy("block").applyInPandas(multiply, "config int, block bigint, n bigint, total binary, cross_ binary, head binary, tail binary")
    return sums.groupBy("config").applyInPandas(merge, "rep bigint, t double").groupBy("rep").agg(F.max("t").alias("max_t"))


# --- path bootstraps -----------------------------------------------------------------------------


#: Trades whose draws are packed together, and the numbers of one packed block of trades.
PACK_ROWS, PACK_BLOCK = 50_000, 1 << 15


def packed(df: DataFrame, key: str, deal: Callable[[pd.DataFrame], tuple[np.ndarray, dict[str, np.ndarray]]], names: Sequence[str]) -> DataFrame:
    """(key, cell, names as packed arrays): many draws of a row go to the shuffle as a few bytes each.

    ``deal`` gives from a frame the cells, a row for each row and a column for each draw, and what goes there.
    """
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        cell, cols = deal(frame)
        code, labels = pd.factorize(frame[key])
        owner, cell = np.repeat(code, cell.shape[1]), cell.ravel()
        order = np.lexsort((cell, owner))
        owner, cell = owner[order], cell[order]
        start = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1]))))
        out = {key: np.asarray(labels)[owner[start]], "cell": cell[start]}
        for k in names:
            flat = cols[k].ravel()[order]
            out[k] = [x.tobytes() for x in np.split(flat, start[1:])]
        return pd.DataFrame(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size >= PACK_ROWS:
                yield one(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if size:
            yield one(pd.concat(held, ignore_index=True))

    kind = df.schema[key].dataType.simpleString()
    return df.where(c(key).isNotNull()).mapInPandas(run, f"{key} {kind}, cell bigint, {', '.join(f'{k} binary' for k in names)}")


def _draws(seed: int, n: int, *cols: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda rep: draw(seed, rep, *cols))


def prob_profit_factor(trades: DataFrame, key: str, order: Sequence[str], x: str, above: float, n: int, seed: int, width: int, least: int = 5) -> DataFrame:
    """(key, n, prob_pf): share of resamples (with replacement) whose profit factor is above ``above``; 0 below ``least`` trades.

    Draws meet trades by blocks of ``PACK_BLOCK`` numbers, packed to a place and a replicate each.
    """
    p = pin(number_rows(trades.select(key, *order, c(x).alias("_x")), [key], order, width).select(key, RN, "_x"))
    size = p.groupBy(key).agg((F.max(RN) + 1).alias("_size"))
    d = p.select(key, F.col(RN).alias("_i")).join(size, key).select(key, "_size", _draws(seed, n, key, "_i").alias("_draws"))

    def deal(f: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        to = np.stack(f["_draws"].to_numpy()) % f["_size"].to_numpy("int64")[:, None]
        return to // PACK_BLOCK, {"place": (to % PACK_BLOCK).astype("uint16"), "rep": np.broadcast_to(np.arange(n, dtype="uint16"), to.shape)}

    def meet(draws: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = [key, "rep", "up", "down"]
        if not len(draws) or not len(own):
            return pd.DataFrame({k: [] for k in names})
        value = np.zeros(PACK_BLOCK)
        value[own[RN].to_numpy("int64") % PACK_BLOCK] = own["_x"].fillna(0.0)
        rep = np.concatenate([np.frombuffer(b, "uint16") for b in draws["rep"]])
        got = value[np.concatenate([np.frombuffer(b, "uint16") for b in draws["place"]])]
        sums = [np.bincount(rep, np.maximum(v, 0.0), n) for v in (got, -got)]
        return pd.DataFrame({key: own[key].iloc[0], "rep": np.arange(n), "up": sums[0], "down": sums[1]})[np.bincount(rep, minlength=n) > 0]

    kind = trades.schema[key].dataType.simpleString()
    own = p.withColumn("cell", F.floor(F.col(RN) / PACK_BLOCK)).groupBy(key, "cell")
    d = packed(d, key, deal, ["place", "rep"]).groupBy(key, "cell").cogroup(own).applyInPandas(meet, f"{key} {kind}, rep int, up double, down double")
    g = d.groupBy(key, "rep").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    hit = F.when(F.col("down") <= 1e-12, F.col("up") > 0).otherwise(F.col("up") / F.col("down") > above)
    out = size.join(g.groupBy(key).agg(F.avg(ind(hit)).alias("p")), key, "left")
    return out.select(key, F.col("_size").alias("n"), F.when(F.col("_size") < least, 0.0).otherwise(F.col("p")).alias("prob_pf"))


def prob_drawdown(trades: DataFrame, key: str, unit: str, x: str, below: float, n: int, seed: int, target: int = 100_000, least: int = 5) -> DataFrame:
    """(key, prob_dd): share of random orders of the trades whose largest fall of compounded equity stays under ``below``.

    An order is by digest, then by the whole number ``unit``; ranges of digests are blocks of about ``target`` trades, to
    which trades go packed. A block keeps its sum of logarithms, its highest and lowest point and its deepest fall, and
    blocks combine in order: the deepest fall is one inside a block or from the highest point before it to its lowest. The
    first trade's equity is the first peak.
    """
    size = trades.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = size.agg(F.max("_n")).first()[0] or 0
    parts = max(1, -(-top // target))
    d = trades.select(key, c(unit).cast("bigint").alias("_u"), F.log1p(c(x)).alias("_l"), _draws(seed, n, unit).alias("_draws")).where("_l IS NOT NULL")

    def deal(f: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at = np.stack(f["_draws"].to_numpy())
        wide = lambda v: np.broadcast_to(v[:, None], at.shape)
        return np.arange(n) * parts + (at * parts >> 32), {"at": at.astype("uint32"), "unit": wide(f["_u"].to_numpy("int64")), "log": wide(f["_l"].to_numpy("float64"))}

    def block(f: pd.DataFrame) -> pd.DataFrame:
        at, unit, log = (np.concatenate([np.frombuffer(b, t) for b in f[k]]) for k, t in (("at", "uint32"), ("unit", "int64"), ("log", "float64")))
        path = np.cumsum(log[np.lexsort((unit, at))])
        rep, b = divmod(int(f["cell"].iloc[0]), parts)
        return pd.DataFrame({key: [f[key].iloc[0]], "rep": [rep], "_b": [b], "sum": [path[-1]], "high": [path.max()], "low": [path.min()], "fall": [(path - np.maximum.accumulate(path)).min()]})

    kind = trades.schema[key].dataType.simpleString()
    b = packed(d, key, deal, ["at", "unit", "log"]).groupBy(key, "cell").applyInPandas(block, f"{key} {kind}, rep int, _b bigint, sum double, high double, low double, fall double")
    before = Window.partitionBy(key, "rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    b = b.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    b = b.withColumn("peak", F.max(F.col("start") + F.col("high")).over(before))
    g = b.groupBy(key, "rep").agg(F.min(F.least("fall", F.coalesce(F.col("start") + F.col("low") - F.col("peak"), F.lit(0.0)))).alias("worst"))
    out = size.join(g.groupBy(key).agg(F.avg(ind(F.abs(F.expm1("worst")) < below)).alias("p")), key, "left")
    return out.select(key, F.when(F.col("_n") < least, 0.0).otherwise(F.col("p")).alias("prob_dd"))


# --- signals that rank alike ---------------------------------------------------------------------


def rank_duplicates(ranks: DataFrame, *, name: str, at: str, cell: str, rank: str, agree: float = 0.999, least: int = 500, bands: int = 4) -> DataFrame:
    """(name, representative, exact): signals whose cross-sectional ranks are the same up to coverage.

    Signals of one fingerprint (all cells and ranks, rounded to 9 digits) fold into the first by name. Two of those left
    are candidates if on some day they share one of ``bands`` smallest hashes of (cell, rank), as they nearly always do
    on some day when they agree on ``agree`` of many days' cells. Candidates are compared on the cells both have, at
    least ``least``; in the order of names each signal then joins the first representative it agrees with.
    """
    d = ranks.where(c(rank).isNotNull()).select(c(name).alias("name"), c(at).alias("at"), c(cell).alias("cell"), F.round(c(rank), 9).alias("rank"))
    marks = [F.sum(F.xxhash64(F.lit(i), "at", "cell", "rank").cast("decimal(38,0)")) for i in (1, 2)]
    prints = d.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[m.alias(f"h{i}") for i, m in enumerate(marks)])
    first = pin(prints.withColumn("exact", F.min("name").over(Window.partitionBy("n", "h0", "h1"))).select("name", "exact"))
    left = pin(d.join(first.where("name = exact").select("name"), "name", "left_semi"))
    hashes = left.groupBy("name", "at").agg(*[F.min(F.xxhash64(F.lit(100 + i), "cell", "rank")).alias(f"b{i}") for i in range(bands)])
    keys = hashes.select("name", F.explode(F.array(*[F.xxhash64(F.lit(i), "at", f"b{i}") for i in range(bands)])).alias("band")).distinct()
    near = pin(keys.join(keys.withColumnRenamed("name", "other"), "band").where("name < other").select("name", "other").distinct())
    a = near.join(left, "name").select("name", "other", "at", "cell", "rank")
    both = a.join(left.select(F.col("name").alias("other"), "at", "cell", F.col("rank").alias("rank_")), ["other", "at", "cell"])
    edges = both.groupBy("name", "other").agg(F.count(F.lit(1)).alias("n"), F.avg(ind(F.abs(F.col("rank") - F.col("rank_")) <= 1e-12)).alias("share")).where((F.col("n") >= least) & (F.col("share") >= agree))
    edges = pin(edges.select("name", "other"))
    # in the order of names: who has no open smaller neighbour leads; its neighbours join their smallest leader once all smaller ones are settled
    state = pin(first.where("name = exact").select("name", F.lit(None).cast("string").alias("lead")))
    while not state.where("lead IS NULL").isEmpty():
        seen = edges.join(state.select("name", F.col("lead").alias("upper")), "name").groupBy(F.col("other").alias("name")).agg(
            F.min(F.when(F.col("upper").isNull(), F.col("name"))).alias("open"), F.min(F.when(F.col("upper") == F.col("name"), F.col("name"))).alias("leader"))
        now = state.join(seen, "name", "left")
        settled = F.when(F.col("lead").isNotNull(), F.col("lead")).when(F.col("leader").isNotNull() & (F.col("open").isNull() | (F.col("leader") < F.col("open"))), F.col("leader")).when(F.col("open").isNull(), F.col("name"))
        state = pin(now.select("name", settled.alias("lead")))
    return first.join(state.withColumnRenamed("name", "exact"), "exact").select("name", F.col("lead").alias("representative"), (F.col("name") != F.col("exact")).alias("exact"))


# --- least squares from sums ---------------------------------------------------------------------


def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, prefix: str = "") -> DataFrame:
    """(keys, n, sums, squares): sums of the regressors and the target, and of all their products, as arrays; they add up over any split of the rows."""
    cols = [c(v).cast("double") for v in (*xs, y)]
    pairs = [cols[i] * cols[j] for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"), F.array(*[F.sum(v) for v in cols]).alias(f"{prefix}sums"), F.array(*[F.sum(p) for p in pairs]).alias(f"{prefix}squares"))


def centred(n: float, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The matrix of centred products of regressors and target (last)."""
    k = len(sums)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = squares
    m = m + np.triu(m, 1).T
    return m - np.outer(sums, sums) / n


def non_negative_ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients b >= 0 of least squares with penalty ``alpha`` on their squares, from centred products; Cholesky on each support."""
    k = len(m) - 1
    best, out = 0.0, np.zeros(k)
    for size in range(1, k + 1):
        for on in map(list, combinations(range(k), size)):
            low = np.linalg.cholesky(m[np.ix_(on, on)] + alpha * np.eye(size))
            b = np.linalg.solve(low.T, np.linalg.solve(low, m[on, k]))
            gain = float(b @ m[on, k])
            if (b > 0).all() and gain > best:
                best, out = gain, np.zeros(k)
                out[on] = b
    return out


def ridge_fits(train: DataFrame, test: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, alpha: float) -> DataFrame:
    """(keys, n_train, n_test, intercept, b_<x>, r2_train, r2_test): one non-negative ridge for each key, from sums alone.

    At most a few regressors: each support is tried. ``test`` rows may be missing for a key.
    """
    keys, xs = list(keys), list(xs)
    sums = gram(train, keys, xs, y, "a_").join(gram(test, keys, xs, y, "b_"), keys, "left")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema.fields)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = centred(r.a_n, np.array(r.a_sums), np.array(r.a_squares))
                b = non_negative_ridge(m, alpha)
                mean = np.array(r.a_sums) / r.a_n
                fit = [fit_of(m, b, r.a_n)]
                has = r.b_sums is not None
                fit.append(fit_of(centred(r.b_n, np.array(r.b_sums), np.array(r.b_squares)), b, r.b_n) if has else None)
                rows.append((*[getattr(r, k) for k in keys], int(r.a_n), int(r.b_n) if has else 0, float(mean[-1] - b @ mean[:-1]), *b.tolist(), *fit))
            yield pd.DataFrame(rows, columns=[*keys, "n_train", "n_test", "intercept", *[f"b_{x}" for x in xs], "r2_train", "r2_test"])

    return sums.mapInPandas(solve, f"{kinds}, n_train bigint, n_test bigint, intercept double, {', '.join(f'b_{x} double' for x in xs)}, r2_train double, r2_test double")


def fit_of(m: np.ndarray, b: np.ndarray, n: float) -> float:
    """1 - var(y - prediction) / (var(y) + 1e-9), from centred products."""
    left = m[-1, -1] - 2 * b @ m[:-1, -1] + b @ m[:-1, :-1] @ b
    return float(1 - (left / n) / (m[-1, -1] / n + 1e-9))
