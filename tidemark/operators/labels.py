"""Forward-looking labels over a sequence with enough ``ahead`` rows.

An incomplete future gives null, never 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, div
from tidemark.operators.blocks import Seq


def lead(s: Seq, x, k: int) -> Column:
    return F.lead(c(x), k).over(s.by())


def forward_log_return(s: Seq, price, k: int) -> Column:
    return F.ln(div(lead(s, price, k), price))


def forward_bps(s: Seq, price, k: int) -> Column:
    return 10_000.0 * forward_log_return(s, price, k)


def next_rows(s: Seq, n: int, **cols) -> Column:
    """The next n rows as an array of structs."""
    return F.collect_list(F.struct(*[c(v).alias(k) for k, v in cols.items()])).over(s.rows(1, n))


def first_place(rows: Column, test) -> Column:
    """Place (from 1) of the first row that passes ``test``, 0 if none does."""
    return F.array_position(F.transform(rows, test), F.lit(True))


def barrier(s: Seq, n: int, rows: Column, up: Column, down: Column, tie_up: bool = True) -> Column:
    """1 if ``up`` is reached first, -1 if ``down`` is, 0 if neither; null without n rows ahead.

    ``rows`` holds structs with ``h`` and ``l``; a tie in one bar goes up or down by ``tie_up``.
    """
    a = first_place(rows, lambda r: r["h"] >= up)
    b = first_place(rows, lambda r: r["l"] <= down)
    first_up = (a > 0) & ((b == 0) | ((a <= b) if tie_up else (a < b)))
    label = F.when(first_up, 1).when(b > 0, -1).otherwise(0)
    return F.when(F.size(rows) == n, label)


def time_to(rows: Column, test) -> Column:
    k = first_place(rows, test)
    return F.when(k > 0, k)


def economic_side(rows: Column, n: int, price: Column, tp: float, sl: float, cost: float, side: int) -> Column:
    """Net log result of a take-profit / stop-loss pair; the stop wins a tie; timeout at the last close."""
    if side > 0:
        win = first_place(rows, lambda r: r["h"] >= price * (1 + tp))
        lose = first_place(rows, lambda r: r["l"] <= price * (1 - sl))
    else:
        win = first_place(rows, lambda r: r["l"] <= price * (1 - tp))
        lose = first_place(rows, lambda r: r["h"] >= price * (1 + sl))
    out = F.when((win > 0) & ((lose == 0) | (win < lose)), math.log(1 + tp)).when(lose > 0, math.log(1 - sl))
    out = out.otherwise(side * F.ln(div(F.try_element_at(rows, F.lit(-1))["c"], price)))
    return F.when(F.size(rows) == n, out - cost)


def future_volatility(s: Seq, r, n: int) -> Column:
    w = s.rows(1, n)
    return F.when(F.count(c(r)).over(w) == n, F.stddev_samp(c(r)).over(w))


def forward_sum(s: Seq, r, n: int) -> Column:
    """Sum of the next n increments, the own row excluded."""
    w = s.rows(1, n)
    return F.when(F.count(c(r)).over(w) == n, F.sum(c(r)).over(w))


def path_columns(s: Seq, r: str, cum: str, n: int) -> dict[str, Column]:
    """Forward path of n increments starting with the own row: end, best, worst and their places.

    ``cum`` is any running sum of ``r``; only its differences are used.
    """
    w = s.rows(0, n - 1)
    base = c(cum) - c(r)
    full = F.count(c(r)).over(w) == n
    place = F.row_number().over(s.by())
    return {
        "end": F.when(full, F.sum(c(r)).over(w)), "top": F.when(full, F.greatest(F.max(c(cum)).over(w) - base, F.lit(0.0))),
        "bottom": F.when(full, F.least(F.min(c(cum)).over(w) - base, F.lit(0.0))),
    }


def trend_label(ret: Column, vol: Column, n: int, k: float, cost_bps: float, per_year: float) -> Column:
    """Sign of the forward return if it exceeds k volatilities plus cost, else 0."""
    wall = k * vol * math.sqrt(n / per_year) + cost_bps / 10_000.0
    return F.when(ret.isNotNull() & vol.isNotNull(), F.when(F.abs(ret) > wall, F.signum(ret)).otherwise(0.0))


def net_carry(funding: Column, adverse: Column, hours: float, cost: float) -> Column:
    """Carry earned over the horizon less adverse move and cost, with its class."""
    return F.abs(funding) * hours / 8.0 - adverse - cost


def event_cost(price: Column, tick: float, fee: float) -> Column:
    return 2.0 * fee + div(F.lit(2.0 * tick), price)


def split_by_year(year: Column, train_end: int, val: int, test_from: int) -> Column:
    return F.when(year <= train_end, "train").when(year == val, "val").when(year >= test_from, "test")


def target(s: Seq, name: str, price: str, n: int) -> Column:
    """A named forward target: return, bps, volatility or convergence."""
    known = {
        "forward_return": lambda: forward_log_return(s, price, n),
        "forward_bps": lambda: forward_bps(s, price, n),
        "future_volatility": lambda: future_volatility(s, "r", n),
        "convergence": lambda: -(lead(s, price, n) - c(price)),
    }
    return known[name]()
