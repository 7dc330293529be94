"""Views of the given tables as market data, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch_us
from tidemark.operators.resample import HOUR_US, ohlcv

DAY_US = 24 * HOUR_US


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """events as trades: symbol, venue, price, quantity and side. A print without a positive price is no trade."""
    e = read(spark, folder, "events").where("value > 0")
    return e.select(
        "event_id", epoch_us("ts").alias("ts_us"),
        F.concat(F.lit("S"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("symbol"),
        "user_id", (F.col("user_id") % 3).alias("venue"), F.col("event_type").alias("kind"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("qty"),
        F.col("event_type").isin("error", "signup").alias("is_sell"))


TICKS = """ticks AS (SELECT event_id, epoch_us(ts) AS ts_us, 'S' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS symbol,
 user_id, user_id % 3 AS venue, event_type AS kind, value AS price,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS qty, event_type IN ('error', 'signup') AS is_sell FROM events WHERE value > 0)"""


def bars(spark: SparkSession, folder: str, width: int = HOUR_US) -> DataFrame:
    """Hourly bars of the trades; one row per symbol and hour, so a symbol is bounded by its calendar."""
    return ohlcv(ticks(spark, folder), keys=["symbol"], clock="ts_us", order=["ts_us", "event_id"], price="price",
                 qty="qty", width=width, buy=~F.col("is_sell"))


def bars_sql(width: int = HOUR_US) -> str:
    return f"""bars AS (SELECT symbol, ts_us - ts_us % {width} AS bar, arg_min(price, (ts_us, event_id)) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, (ts_us, event_id)) AS close, CAST(sum(qty) AS DOUBLE) AS volume,
 sum(price * qty) AS quote_volume, CAST(count(*) AS DOUBLE) AS trades,
 sum(CASE WHEN NOT is_sell THEN CAST(qty AS DOUBLE) ELSE 0 END) AS taker_buy_base,
 sum(CASE WHEN NOT is_sell THEN price * qty ELSE 0 END) AS taker_buy_quote FROM ticks GROUP BY 1, 2)"""


BARS = f"{TICKS},\n{bars_sql()}"


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a daily panel of 20 names: prices, volumes, funding, open interest, ratio and spot."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")
    d = read(spark, folder, "lineitem").select(
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"),
        F.concat(F.lit("P"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 2, "0")).alias("symbol"),
        p.alias("price"), place.alias("place"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return d.groupBy("day", "symbol").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "place").alias("close"), F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("qv"), F.count(F.lit(1)).cast("double").alias("cnt"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("tbq"),
        F.round(F.avg("l_discount") - 0.05, 9).alias("fund"), F.round(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))), 5).alias("oi"),
        F.round(F.avg("l_tax") + 0.5, 9).alias("ratio"), F.round(F.max_by("l_tax", "place") + 0.4, 9).alias("ratio2"),
        F.round(F.avg("price") * 0.998, 6).alias("spot"))


PANEL = """src AS (SELECT CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS day, 'P' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') AS symbol,
 l_extendedprice / l_quantity AS price, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS place,
 l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem),
panel AS (SELECT CAST(day AS BIGINT) AS day, symbol, arg_min(price, place) AS open, max(price) AS high, min(price) AS low, arg_max(price, place) AS close,
 sum(l_quantity) AS volume, sum(l_extendedprice) AS qv, CAST(count(*) AS DOUBLE) AS cnt,
 sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS tbq, round(avg(l_discount) - 0.05, 9) AS fund,
 round(sum(l_extendedprice * (1 + l_tax)), 5) AS oi, round(avg(l_tax) + 0.5, 9) AS ratio, round(arg_max(l_tax, place) + 0.4, 9) AS ratio2, round(avg(price) * 0.998, 6) AS spot FROM src GROUP BY 1, 2)"""


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """orders as decisions of 50 symbols with a gross result in bps."""
    o = read(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), epoch_us("o_orderdate").alias("ts_us"), F.year("o_orderdate").cast("bigint").alias("year"),
        F.concat(F.lit("D"), F.lpad((F.col("o_custkey") % 50).cast("string"), 2, "0")).alias("symbol"),
        ((F.col("o_totalprice") - 250_000.0) / 1_000.0).alias("gross_bps"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).cast("bigint").alias("side"), F.col("o_orderpriority").alias("tier"))


DECISIONS = """decisions AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS ts_us, year(o_orderdate) AS year,
 'D' || lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') AS symbol, (o_totalprice - 250000.0) / 1000.0 AS gross_bps,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS side, o_orderpriority AS tier FROM orders)"""
