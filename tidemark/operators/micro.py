"""Order-book, trade-flow and cross-venue state as columns and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clip, div, ind
from tidemark.operators.asof import Context, asof_contexts, asof_join, cumulative_at, window_sums
from tidemark.operators.blocks import latest, sequence


def total(levels: Column, value) -> Column:
    return F.aggregate(F.transform(levels, value), F.lit(0.0), lambda a, v: a + v)


def sorted_levels(price: str, qty: str, bid: Column, best_high: bool) -> Column:
    """Aggregate: one side's levels as an array of (price, qty), best first."""
    arr = F.array_sort(F.collect_list(F.when(bid, F.struct(c(price).alias("price"), c(qty).alias("qty")))))
    return F.reverse(arr) if best_high else arr


def depth_within(levels: Column, mid: Column, bps: float) -> Column:
    return total(F.filter(levels, lambda v: F.abs(div(v["price"], mid) - 1.0) * 1e4 <= bps), lambda v: v["qty"])


def queue_imbalance(bids: Column, asks: Column, n: int) -> Column:
    b, a = total(F.slice(bids, 1, n), lambda v: v["qty"]), total(F.slice(asks, 1, n), lambda v: v["qty"])
    return F.coalesce(div(b - a, b + a), F.lit(0.0))


def book_vector(bids: Column, asks: Column, band: float, move: float) -> dict[str, Column]:
    """Mid, spread, microprice offset, imbalances, band depths, notional to move and weighted distance."""
    b, a = F.try_element_at(bids, F.lit(1)), F.try_element_at(asks, F.lit(1))
    mid = (b["price"] + a["price"]) / 2.0
    micro = div(a["price"] * b["qty"] + b["price"] * a["qty"], b["qty"] + a["qty"])
    dist = lambda v: F.abs(div(v["price"], mid) - 1.0) * 1e4
    both = F.concat(bids, asks)
    return {
        "mid": mid, "spread_bps": div(a["price"] - b["price"], mid) * 1e4, "micro_offset_bps": (div(micro, mid) - 1.0) * 1e4,
        "imbalance_1": queue_imbalance(bids, asks, 1), "imbalance_5": queue_imbalance(bids, asks, 5),
        "bid_depth": depth_within(bids, mid, band), "ask_depth": depth_within(asks, mid, band),
        "notional_up": total(F.filter(asks, lambda v: v["price"] <= mid * (1 + move / 1e4)), lambda v: v["price"] * v["qty"]),
        "weighted_distance_bps": div(total(both, lambda v: dist(v) * v["qty"]), total(both, lambda v: v["qty"])),
    }


def top_ofi(s, pb: str, qb: str, pa: str, qa: str) -> Column:
    """Order-flow imbalance of the best quotes between a row and the one before."""
    w = s.by()
    p = {x: F.lag(x).over(w) for x in (pb, qb, pa, qa)}
    return (ind(c(pb) >= p[pb], c(qb)) - ind(c(pb) <= p[pb], p[qb]) - ind(c(pa) <= p[pa], c(qa)) + ind(c(pa) >= p[pa], p[qa]))


def slippage(bands: Column, notional: float) -> Column:
    """Band (bps) at which the cumulative notional reaches the order, linear inside a band; missing beyond the book.

    ``bands`` is a sorted array of (bps, cumulative notional).
    """
    k = F.array_position(F.transform(bands, lambda b: b["cum"] >= notional), F.lit(True)).cast("int")
    hit = F.try_element_at(bands, F.when(k > 0, k))
    prev = F.try_element_at(bands, F.when(k > 1, k - 1))
    lo_b, lo_c = F.coalesce(prev["bps"].cast("double"), F.lit(0.0)), F.coalesce(prev["cum"], F.lit(0.0))
    return lo_b + (hit["bps"] - lo_b) * F.coalesce(div(notional - lo_c, hit["cum"] - lo_c), F.lit(0.0))


def trade_flow(df: DataFrame, keys: Sequence[str], clock: str, order: Sequence[str], usd: Column, sell: Column, price: str) -> DataFrame:
    """Per group: counts, signed and gross flow, imbalance, move, impact, absorption, rate, gap variation."""
    s = sequence(df.withColumns({"_usd": usd, "_sell": sell}), keys, order, back=1)
    d = s.add({"_gap": (c(clock) - F.lag(clock).over(s.by())) / 1e6}).result()
    o = F.struct(*order)
    signed = F.when(F.col("_sell"), -F.col("_usd")).otherwise(F.col("_usd"))
    d = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(signed).alias("signed"), F.sum("_usd").alias("gross"),
        (1e4 * F.ln(div(F.max_by(price, o), F.min_by(price, o)))).alias("move_bps"), ((F.max(clock) - F.min(clock)) / 1e6).alias("_span"),
        div(F.stddev_pop("_gap"), F.avg("_gap")).alias("gap_cv"))
    return d.withColumns({
        "imbalance": F.coalesce(div("signed", "gross"), F.lit(0.0)), "impact_per_million": div(F.col("move_bps") * 1e6, F.abs("signed")),
        "absorption": div("gross", F.abs("move_bps") + 1.0), "rate": div("n", "_span")}).drop("_span")


def grid_flow(grid: DataFrame, trades: DataFrame, by: Sequence[str], clock: str, trade_clock: str, span: int, usd: Column, sell: Column) -> DataFrame:
    """Trade flow in (t - span, t] at each grid row, by running sums."""
    one = F.lit(1)
    d = window_sums(grid, trades, by=by, left_clock=clock, right_clock=trade_clock, lo=-span, hi=0, lo_open=True,
                    values={"n": one, "gross": usd, "signed": F.when(sell, -usd).otherwise(usd)})
    return d.withColumns({"imbalance": F.coalesce(div("signed", "gross"), F.lit(0.0)), "rate": F.col("n") / (span / 1e6)})


def last_per_price(updates: DataFrame, keys: Sequence[str], price: str, order: Sequence[str]) -> DataFrame:
    """The newest update of every price level; combined before the shuffle."""
    return latest(updates, [*keys, price], order)


def book_at_grid(updates: DataFrame, *, keys: Sequence[str], side: str, price: str, qty: str, action: str, clock: str, order: Sequence[str],
                 step: int) -> DataFrame:
    """(keys, slot, side, price, qty): standing levels at the end of each slot.

    An update sets its level's quantity until the next update of that level or the next
    snapshot; ``remove`` or qty <= 0 deletes; rows before a key's first snapshot are
    ignored. Each update becomes the run of slots it stands for, so a book of any length
    is rebuilt in parallel by level.
    """
    keys = list(keys)
    u = updates.withColumn("_slot", F.floor(c(clock) / step))
    snaps = u.where(c(action) == "snapshot").groupBy(*keys, "_slot").agg(F.max(clock).alias("_snap"))
    first = snaps.groupBy(*keys).agg(F.min("_snap").alias("_first"))
    # The newest update per level and slot, not older than the slot's own snapshot.
    u = u.join(first, keys).where(c(clock) >= F.col("_first")).join(snaps, [*keys, "_slot"], "left")
    u = u.where(F.col("_snap").isNull() | (c(clock) >= F.col("_snap")))
    u = latest(u.select(*keys, "_slot", side, price, qty, action, *[o for o in order if o not in (price, qty)]), [*keys, "_slot", side, price], order)
    ends = snaps.groupBy(*keys).agg(F.max("_slot").alias("_z"))
    w = Window.partitionBy(*keys, side, price).orderBy("_slot")
    u = u.withColumn("_next", F.lead("_slot").over(w))
    clears = snaps.select(*keys, F.col("_slot").alias("_clear"))
    u = u.withColumn("_after", F.col("_slot") + 1)
    u = asof_join(u, clears, by=keys, left_clock="_after", right_clock="_clear", cols=[], prefix="c", direction="forward", width=10_000)
    last = updates.groupBy(*keys).agg(F.floor(F.max(clock) / step).alias("_end"))
    u = u.join(last, keys)
    stop = F.least(F.coalesce("_next", F.col("_end") + 1), F.coalesce("c_clear", F.col("_end") + 1))
    u = u.where((c(action) != "remove") & (c(qty) > 0)).withColumn("_stop", stop).where(F.col("_stop") > F.col("_slot"))
    return u.withColumn("slot", F.explode(F.sequence(F.col("_slot"), F.col("_stop") - 1))).select(*keys, "slot", side, price, qty)


def wallet_scores(trades: DataFrame, prices: DataFrame, *, by: str, wallet: str, clock: str, price: str, sell: str, unit: str, fair: str,
                  fair_clock: str, horizon: int, prior: float) -> DataFrame:
    """Each trade with its wallet's score from markouts that had matured before it.

    A trade's markout is its signed move to the fair price ``horizon`` later; it counts
    from that instant on. The score is sum/(count + prior).
    """
    t = trades.withColumn("_ripe", c(clock) + horizon)
    t = asof_join(t, prices, by=[by], left_clock="_ripe", right_clock=fair_clock, cols=[fair], prefix="m_")
    sign = F.when(c(sell), -1.0).otherwise(1.0)
    t = t.withColumn("markout_bps", sign * 1e4 * (div(f"m_{fair}", price) - 1.0)).drop(f"m_{fair}", f"m_{fair_clock}")
    ripe = t.where(F.col("markout_bps").isNotNull()).select(wallet, F.col("_ripe").alias("_clk"), F.lit(True).alias("_late"), F.col("markout_bps").alias("_ms"), F.lit(1).alias("_mn"))
    d = cumulative_at(t, ripe, by=[wallet], left_clock=c(clock), values=["_ms", "_mn"])
    return d.withColumn("score", F.col("_ms") / (F.col("_mn") + prior)).withColumnRenamed("_mn", "matured").drop("_ms", "_ripe")


def capacity(policy: Column, oi: Column, top: Column, volume_24h: Column, hours: float, oi_share: float, participation: float) -> Column:
    """Notional a trade may take under its policy; missing where the input is not measured."""
    return F.when(policy == "oi", oi * oi_share).when(policy == "top", top).when(policy == "volume", volume_24h * hours / 24.0 * participation)


def band_metrics(bids: str, asks: str, bands: Sequence[int]) -> dict[str, Column]:
    """Mid, spread, notional within each band, the widest band the levels reach on both sides, and the imbalance of the first.

    Bids stand highest first, asks lowest first, as (price, qty). A band beyond the levels given is missing, not guessed.
    """
    b, a = c(bids), c(asks)
    best_bid, best_ask = F.element_at(b, 1)["price"], F.element_at(a, 1)["price"]
    mid = (best_bid + best_ask) / 2.0
    low, high = F.element_at(b, -1)["price"], F.element_at(a, -1)["price"]
    covered = F.lit(0)
    for x in sorted(bands):
        covered = F.when((low <= mid * (1 - x / 1e4)) & (high >= mid * (1 + x / 1e4)), F.lit(x)).otherwise(covered)
    out = {"mid": mid, "bid": best_bid, "ask": best_ask, "spread_bps": (best_ask - best_bid) / mid * 1e4}
    notional = lambda levels, keep: total(F.filter(levels, keep), lambda v: v["price"] * v["qty"])
    at_least, at_most = (lambda p: lambda v: v["price"] >= p), (lambda p: lambda v: v["price"] <= p)
    for x in bands:
        out[f"bid_{x}"] = F.when(covered >= x, notional(b, at_least(mid * (1 - x / 1e4))))
        out[f"ask_{x}"] = F.when(covered >= x, notional(a, at_most(mid * (1 + x / 1e4))))
    first = min(bands)
    gap, both = out[f"bid_{first}"] - out[f"ask_{first}"], out[f"bid_{first}"] + out[f"ask_{first}"]
    return out | {"covered_bps": covered, f"imbalance_{first}": div(gap, both)}


# --- what a launch book supports -----------------------------------------------------------------

#: Requested bands (bps), order sizes, and limits of the status.
LAUNCH_BANDS, NOTIONALS, WIDE_BPS, THIN_USD = (10, 25, 50), (100.0, 500.0, 1000.0), 50.0, 1000.0


def native_within(side: Column, bps: float) -> tuple[Column, Column]:
    """(cumulative notional, band) of the largest native band not beyond ``bps``; missing below the first band, never interpolated.

    ``side`` is a sorted array of (bps, cum).
    """
    last = F.try_element_at(F.filter(side, lambda b: b["bps"] <= bps), F.lit(-1))
    return last["cum"], last["bps"]


def band_imbalance(bids: Column, asks: Column, bps: float) -> Column:
    b, a = native_within(bids, bps)[0], native_within(asks, bps)[0]
    return F.when(b + a > 0, (b - a) / (b + a))


def at_band(side: Column, bps: int) -> Column:
    return F.try_element_at(F.filter(side, lambda b: b["bps"] == bps), F.lit(1))["cum"]


def launch_depth(bids: str, asks: str, ok: Column) -> dict[str, Column]:
    """Depths within the requested bands and whether they are lower bounds, native depths, slippage of orders with its upper bound, imbalances; all missing where the book is not ``ok``."""
    out: dict[str, Column] = {"resolution_bps": F.when(ok, F.least(F.element_at(bids, 1)["bps"], F.element_at(asks, 1)["bps"]))}
    for name, side, act in (("bid", c(bids), "sell"), ("ask", c(asks), "buy")):
        for b in LAUNCH_BANDS:
            v, used = native_within(side, b)
            out[f"{name}_depth_{b}"], out[f"{name}_depth_{b}_is_bound"] = F.when(ok, v), F.when(ok & v.isNotNull(), used < b)
        for b in (20, 100):
            out[f"{name}_native_{b}"] = F.when(ok, at_band(side, b))
        for n in NOTIONALS:
            reach = F.try_element_at(filled(side, n), F.lit(1))
            out[f"{act}_slippage_{int(n)}"], out[f"{act}_slippage_{int(n)}_bound"] = F.when(ok, slippage(side, n)), F.when(ok, reach["bps"])
    return out | {f"imbalance_{b}": F.when(ok, band_imbalance(c(bids), c(asks), b)) for b in (10, 20, 25)}


def filled(side: Column, notional: float) -> Column:
    return F.filter(side, lambda x: x["cum"] >= notional)


def capacity_status(ok: str, error: str, resolution: str, bid20: str, ask20: str, bid100: str, ask100: str, spread: str) -> tuple[Column, Column]:
    """(status, score): what the book was seen to support; a score of 50 for depth and 50 for the spread."""
    fine = c(resolution) == 20
    thin = F.when(fine, F.least(F.coalesce(bid20, F.lit(0.0)), F.coalesce(ask20, F.lit(0.0)))).otherwise(F.least(F.coalesce(bid100, F.lit(0.0)), F.coalesce(ask100, F.lit(0.0))))
    depth = 50.0 * clip((F.log10(F.greatest(thin, F.lit(1.0))) - 2.0) / 2.0, 0.0, 1.0) * F.when(fine, 1.0).otherwise(0.5)
    near = F.when(c(spread).isNotNull(), 50.0 * F.greatest(F.lit(0.0), 1.0 - c(spread) / WIDE_BPS)).otherwise(0.0)
    status = (F.when(~c(ok) & c(error).isNotNull(), "BAD_BOOK").when(~c(ok), "NO_DEPTH").when(thin < THIN_USD, "DEPTH_TOO_THIN").when(c(spread) > WIDE_BPS, "SPREAD_TOO_WIDE")
              .when(c(spread).isNull() | ~fine, "UNKNOWN").otherwise("CAPACITY_OK"))
    return status, F.when(c(ok), depth + near).otherwise(0.0)


def fragmentation(bids: str, asks: str, top: int = 10) -> dict[str, Column]:
    """Order counts of the best ``top`` levels (price, qty, orders) of each side, quantity per order, and the imbalance of counts; missing where a side has no counts."""
    out: dict[str, Column] = {}
    for name, side in (("bid", c(bids)), ("ask", c(asks))):
        best = F.filter(F.slice(side, 1, top), lambda v: v["orders"].isNotNull())
        orders = F.when(F.size(best) > 0, F.aggregate(F.transform(best, lambda v: v["orders"].cast("double")), F.lit(0.0), lambda a, v: a + v))
        out[f"{name}_orders"], out[f"{name}_qty_per_order"] = orders, div(total(best, lambda v: v["qty"]), orders)
    return out | {"order_imbalance": div(out["bid_orders"] - out["ask_orders"], out["bid_orders"] + out["ask_orders"])}
