"""Blocked sequences: ordered work on keys of any size.

A window over ``partitionBy(symbol)`` puts one symbol into one task. Where one
symbol may hold a third of all rows that task never ends. The helpers here cut
every key's sequence into blocks of bounded size:

* ``cut``           cuts on a clock and splits the blocks that measure as hot;
* ``number_rows``   gives each row its place in its key, from block counts;
* ``sequence``      cuts on row numbers and copies the neighbouring rows that a
  frame needs (``back`` / ``ahead``), so row frames stay exact;
* ``running_total`` carries the totals of earlier blocks into later ones.

All sizes are measured first. When every key is small the extra passes are
skipped and the plan is a single shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import pin

BLOCK_ROWS = 250_000
DAYS = 40_000  # rows per name of a daily calendar: more than a century
HOURS = 200_000  # rows per name of an hourly calendar: more than twenty years
HOT_LIST = 10_000
BLK, CORE, TB, RN = "_blk", "_core", "_tb", "_rn"


@dataclass(frozen=True)
class Seq:
    """A frame whose rows are ordered within (keys, block)."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    single: bool = False
    size: int = 0
    back: int = 0

    def by(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLK).orderBy(*self.order)

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.by().rowsBetween(lo, hi)

    def add(self, cols: dict[str, Column]) -> Seq:
        return replace(self, df=self.df.withColumns(cols))

    def result(self, *cols: str) -> DataFrame:
        out = self.df.where(F.col(CORE)).drop(BLK, CORE, RN)
        return out.select(*cols) if cols else out


def cut(df: DataFrame, keys: Sequence[str], clock: str, width: int,
        target: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(frame with ``_tb``, list of blocks): clock blocks, those above ``target`` rows split.

    The block list (keys, ``_tb``) is counted once and written, so that later steps reuse
    it without evaluating the frame again. Hot blocks number at most rows/target; a short
    list of them is broadcast, a long one joined.
    """
    keys = list(keys)
    d = df.withColumn(TB, F.col(clock) - F.pmod(F.col(clock), F.lit(width)))
    cells = pin(d.groupBy(*keys, TB).agg(F.count(F.lit(1)).alias("_n")))
    parts = F.least(F.ceil(F.col("_n") / target), F.lit(width)).cast("bigint")
    hot = cells.where(F.col("_n") > target).select(*keys, TB, F.ceil(F.lit(width) / parts).cast("bigint").alias("_step"))
    listed = hot.limit(HOT_LIST + 1).collect()
    if not listed:
        return d, cells.drop("_n")
    step = F.coalesce(F.col("_step"), F.lit(width))
    blocks = cells.drop("_n").join(hot, [*keys, TB], "left")
    blocks = blocks.withColumn(TB, F.explode(F.sequence(F.col(TB), F.col(TB) + width - 1, step))).drop("_step")
    if len(listed) <= HOT_LIST:
        hot = F.broadcast(df.sparkSession.createDataFrame(listed, hot.schema))
    inner = F.col(clock) - F.col(TB)
    d = d.join(hot, [*keys, TB], "left").withColumn(TB, F.col(TB) + inner - F.pmod(inner, step)).drop("_step")
    return d, blocks


def carried(blocks: DataFrame, sums: DataFrame, keys: Sequence[str], agg, cols: Sequence[str]) -> DataFrame:
    """Per block the ``agg`` of ``cols`` over all earlier blocks of its key."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(TB).rowsBetween(Window.unboundedPreceding, -1)
    d = blocks.join(sums, [*keys, TB], "left")
    return d.select(*keys, TB, *[agg(x).over(w).alias(x) for x in cols])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int,
                target: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_rn``: the row's place (from 0) in its key's order, block by block."""
    return running_total(df, keys, order, {RN: F.lit(1)}, width, target).withColumn(RN, (F.col(RN) - 1).cast("bigint"))


def sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int = 0, ahead: int = 0,
             size: int = BLOCK_ROWS, bound: int | None = None) -> Seq:
    """Cut each key's rows into blocks of ``size`` with ``back``/``ahead`` copied rows.

    ``order[0]`` is a whole-number clock; the rest of ``order`` makes the order total.
    Frames that look at most ``back`` rows behind and ``ahead`` rows ahead are exact
    on the rows that ``Seq.result`` keeps. ``bound`` is a known limit of rows per key (one
    row per day or hour of a calendar); with it nothing has to be measured.
    """
    keys, order = list(keys), list(order)
    if bound is not None and bound <= size:
        return Seq(df.withColumn(BLK, F.lit(0).cast("bigint")).withColumn(CORE, F.lit(True)), tuple(keys), tuple(order), True)
    span = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("a"), F.max(order[0]).alias("b"))
    top = span.agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).first()
    if top["n"] is None or top["n"] <= size:
        return Seq(df.withColumn(BLK, F.lit(0).cast("bigint")).withColumn(CORE, F.lit(True)), tuple(keys), tuple(order), True)
    size = max(size, back, ahead, 1)
    width = max(1, int((top["b"] - top["a"] + 1) * size // top["n"]))
    d = number_rows(df, keys, order, width, max(size, 1))
    home = F.floor(F.col(RN) / size)
    place = F.pmod(F.col(RN), F.lit(size))
    copies = F.array_compact(F.array(
        home,
        F.when(place >= size - back, home + 1) if back else F.lit(None).cast("bigint"),
        F.when((place < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("bigint"),
    ))
    d = d.withColumn("_home", home).withColumn(BLK, F.explode(copies))
    d = d.withColumn(CORE, F.col(BLK) == F.col("_home")).drop("_home")
    return Seq(d, tuple(keys), tuple(order), size=size, back=back)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                  width: int, target: int = BLOCK_ROWS) -> DataFrame:
    """Cumulative sums over the whole history of each key, carried across blocks."""
    keys, order, names = list(keys), list(order), list(values)
    temp = {k: f"_v_{k}" for k in names}
    d, blocks = cut(df.withColumns({temp[k]: F.coalesce(v, F.lit(0)) for k, v in values.items()}), keys, order[0], width, target)
    sums = d.groupBy(*keys, TB).agg(*[F.sum(temp[k]).alias(f"_o_{k}") for k in names])
    off = carried(blocks, sums, keys, F.sum, [f"_o_{k}" for k in names])
    w = Window.partitionBy(*keys, TB).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(off, [*keys, TB])
    d = d.withColumns({k: F.coalesce(F.col(f"_o_{k}"), F.lit(0)) + F.sum(temp[k]).over(w) for k in names})
    return d.drop(TB, *temp.values(), *[f"_o_{k}" for k in names])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row per key, the newest (or oldest) by ``order``; combines before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    d = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return d.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
