"""Reading partitioned trees, event files and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import c

CORRUPT = "_corrupt_record"


def tree(spark: SparkSession, root: str, columns: list[str] | None = None, merge: bool = False, **where) -> DataFrame:
    """A Hive-style Parquet tree; equality filters on partition columns prune folders, ``merge`` unites part schemas."""
    d = spark.read.option("mergeSchema", merge).parquet(root)
    for k, v in where.items():
        d = d.where(c(k).isin(v) if isinstance(v, (list, tuple)) else c(k) == v)
    return d.select(*columns) if columns else d


def events(spark: SparkSession, path: str, schema: T.StructType, clock: str | None = None, start: int | None = None,
           stop: int | None = None) -> DataFrame:
    """JSON lines (plain or gzip) that may still be growing; rows outside [start, stop) and broken lines are left out."""
    d = lines(spark, path, schema).where(c(CORRUPT).isNull()).drop(CORRUPT)
    if clock and start is not None:
        d = d.where(c(clock) >= start)
    if clock and stop is not None:
        d = d.where(c(clock) < stop)
    return d


def lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every JSON line, with its text in ``_corrupt_record`` where it could not be read."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def quote_grid(quotes: DataFrame, keys: list[str], clock: str, step: int, bid: str, ask: str, received: str) -> DataFrame:
    """Last quote per grid cell with mid, spread and latency; empty cells stay absent."""
    d = quotes.groupBy(*keys, (c(clock) - F.pmod(c(clock), F.lit(step))).alias("cell")).agg(
        F.max_by(F.struct(bid, ask, clock, received), clock).alias("q"))
    b, a = c(f"q.{bid}"), c(f"q.{ask}")
    mid = (a + b) / 2.0
    return d.select(*keys, "cell", b.alias("bid"), a.alias("ask"), mid.alias("mid"), ((a - b) / mid * 1e4).alias("spread_bps"),
                    ((c(f"q.{received}") - c(f"q.{clock}")) / 1000.0).alias("latency_ms"))


def registry_row(df: DataFrame, name: str, clock: Column) -> DataFrame:
    """One row about a dataset: rows, span and schema digest."""
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    return df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"), F.min(clock).alias("first"), F.max(clock).alias("last"),
                  F.sha2(F.lit(text), 256).alias("schema_digest"))
