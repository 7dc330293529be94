"""Raw exchange rows to typed market columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import c
from tidemark.operators.blocks import latest

# Positions of a raw kline row, and accepted spellings of the bar columns.
KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
ALIASES = {
    "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c", "last"), "volume": ("volume", "v", "vol", "base_volume"),
    "quote_volume": ("quote_volume", "quote_asset_volume", "qv", "turnover"), "trades": ("trades", "count", "number_of_trades", "n"),
    "taker_buy_base": ("taker_buy_base", "taker_buy_base_asset_volume", "taker_buy_volume"),
    "taker_buy_quote": ("taker_buy_quote", "taker_buy_quote_asset_volume", "taker_buy_quote_volume"),
}


def symbol_name(x: str | Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c(x)), "[/-]", ""))


def clock_unit(x: str | Column) -> Column:
    """s, ms, us or ns by magnitude."""
    v = F.abs(c(x))
    return F.when(v >= 10**17, "ns").when(v >= 10**14, "us").when(v >= 10**11, "ms").otherwise("s")


def to_us(x: str | Column) -> Column:
    """Epoch clock of any unit as whole microseconds."""
    v, u = c(x).cast("bigint"), clock_unit(x)
    return F.when(u == "ns", F.call_function("div", v, F.lit(1000))).when(u == "us", v).when(u == "ms", v * 1000).otherwise(v * 1_000_000).cast("bigint")


def klines(df: DataFrame, raw: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per 12-field array in the JSON text column ``raw``."""
    d = df.select(*keep, F.explode(F.from_json(c(raw), "array<array<string>>")).alias("_k"))
    at = lambda i: F.try_element_at("_k", F.lit(i + 1))
    num = lambda i: at(i).try_cast("double").alias(KLINE[i])
    return d.select(*keep, to_us(at(0).try_cast("bigint")).alias("open_time"), *[num(i) for i in range(1, 6)],
                    to_us(at(6).try_cast("bigint")).alias("close_time"), *[num(i) for i in range(7, 11)])


def standard_bars(df: DataFrame, clock: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Canonical bar columns from any spelling; the last arrival of a repeated timestamp stays.

    A missing quote volume is close*volume and missing trade counts are 0, but taker
    columns are never made up: they stay missing.
    """
    have = {x.lower(): x for x in df.columns}

    def find(name):
        for a in ALIASES[name]:
            if a in have:
                return F.col(have[a]).try_cast("double")
        return F.lit(None).cast("double")

    cols = {k: find(k) for k in ALIASES}
    cols["quote_volume"] = F.coalesce(cols["quote_volume"], cols["close"] * cols["volume"])
    cols["trades"] = F.coalesce(cols["trades"], F.lit(0.0))
    d = df.select(*keys, to_us(clock).alias("bar"), *order, *[v.alias(k) for k, v in cols.items()])
    return latest(d, [*keys, "bar"], order).drop(*order)


def envelope(df: DataFrame, **stamps: str) -> DataFrame:
    """Provenance columns and the row's JSON text."""
    return df.withColumn("raw_payload", F.to_json(F.struct(*df.columns))).withColumns({k: F.lit(v) for k, v in stamps.items()})


def full_outer(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Series of several endpoints side by side on one key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(key), "full")
    return out
