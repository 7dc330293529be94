"""The table of named queries: a Spark callable, the rows of the survey it covers, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
# Values are scaled by this before rounding, so that exact halves go the same way in both engines.
NUDGE = 1.00000000000027183


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = DIGITS, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded to ``digits``; in the columns ``arrays`` the elements too, at any depth."""
    def fixed(x, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.round(x * NUDGE, digits)
        return F.transform(x, lambda e: fixed(e, kind.elementType)) if isinstance(kind, T.ArrayType) else x

    return df.select(*[fixed(F.col(f.name), f.dataType).alias(f.name) if f.name in arrays or not isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def query(name: str, covers: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS, arrays: str = "", rounds: bool = False):
    """Register the decorated ``fn(spark, folder)``; ``doubles`` names the columns the SQL rounds, ``arrays`` the lists of doubles.

    ``rounds``: ``fn`` rounds its doubles by itself, for results that repeat each value many times.
    """
    def add(fn):
        text = sql
        if sql is not None and (doubles or arrays):
            fixes = [f"round({d} * {NUDGE:.17f}::DOUBLE, {digits}) + 0.0 AS {d}" for d in doubles.split()]
            fixes += [f"list_transform({d}, lambda q: round(q * {NUDGE:.17f}::DOUBLE, {digits}) + 0.0) AS {d}" for d in arrays.split()]
            text = f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({sql})"
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        run = fn if rounds else lambda spark, folder: rounded(fn(spark, folder), digits, tuple(arrays.split()))
        REGISTRY[name] = Query(name, tuple(covers.split()), run, text)
        return fn

    return add
