"""Source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import epoch_us
from tidemark.operators.resample import HOUR_US
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, TICKS, bars, read, ticks
from tidemark.sources import normalise as N
from tidemark.sources import archives, readers, sinks
from tidemark.streaming import core as S

_SYM = "'S' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0')"


@query("partitioned_upsert", "A1 A2 A3 A4 A5 A19", f"WITH {TICKS} SELECT event_id, symbol, CASE WHEN event_id % 3 = 0 THEN price + 1 ELSE price END AS price, qty, ts_us FROM ticks", "price")
def partitioned_upsert(spark, folder):
    t = ticks(spark, folder).select("event_id", "symbol", "price", "qty", "ts_us", F.floor(F.col("ts_us") / (10 * DAY_US)).alias("decade"))
    path = sinks.scratch(spark, "tree")
    sinks.upsert(t, path, ["event_id"], ["decade"], ["ts_us"])
    sinks.upsert(t.where("event_id % 3 = 0").withColumn("price", F.col("price") + 1), path, ["event_id"], ["decade"], ["ts_us"])
    return readers.tree(spark, path, ["event_id", "symbol", "price", "qty", "ts_us"])


@query("union_schema_scan", "A6", f"WITH {TICKS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN price END AS price, CASE WHEN event_id % 2 = 1 THEN qty END AS qty FROM ticks", "price")
def union_schema_scan(spark, folder):
    t = ticks(spark, folder)
    path = sinks.scratch(spark, "parts")
    t.where("event_id % 2 = 0").select("event_id", "price").write.parquet(f"{path}/part=0")
    t.where("event_id % 2 = 1").select("event_id", "qty").write.parquet(f"{path}/part=1")
    return readers.tree(spark, path, ["event_id", "price", "qty"], merge=True)


_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("price", T.DoubleType())])


@query("event_lines", "A7 A8 A9 A10", f"WITH {TICKS} SELECT event_id, symbol, ts_us, price FROM ticks WHERE event_id % 50 <> 0 AND ts_us >= 1704585600000000", "price")
def event_lines(spark, folder):
    t = ticks(spark, folder)
    path = sinks.scratch(spark, "lines")
    good = F.to_json(F.struct("event_id", "symbol", "ts_us", "price"))
    # Every fiftieth line is cut short, as at the end of a growing file.
    t.select("symbol", F.when(F.col("event_id") % 50 == 0, F.substring(good, 1, 20)).otherwise(good).alias("value")).write.partitionBy("symbol").option("compression", "gzip").text(path)
    return readers.events(spark, f"{path}/*", _EVENT, "ts_us", 1_704_585_600_000_000)


@query("kline_rows", "A12 A13", f"WITH {BARS} SELECT symbol, bar, open, high, low, close, volume, quote_volume, trades FROM bars", "open high low close volume quote_volume trades", digits=4)
def kline_rows(spark, folder):
    b = bars(spark, folder)
    s = lambda x: F.col(x).cast("string")
    row = F.array(F.floor(F.col("bar") / 1000).cast("string"), s("open"), s("high"), s("low"), s("close"), s("volume"), F.floor((F.col("bar") + HOUR_US) / 1000).cast("string"), s("quote_volume"),
                  F.col("trades").cast("bigint").cast("string"), s("taker_buy_base"), s("taker_buy_quote"), F.lit("0"))
    raw = b.select("symbol", F.to_json(F.array(row)).alias("raw"))
    k = N.klines(raw, "raw", ["symbol"]).withColumn("arrival", F.lit(1))
    d = N.standard_bars(k, "open_time", ["symbol"], ["arrival"])
    return d.select("symbol", "bar", "open", "high", "low", "close", "volume", "quote_volume", "trades")


@query("clock_units", "A14 A15", f"WITH {TICKS} SELECT event_id, ['s', 'ms', 'us', 'ns'][event_id % 4 + 1] AS unit, CASE event_id % 4 WHEN 0 THEN ts_us // 1000000 * 1000000 WHEN 1 THEN ts_us // 1000 * 1000 ELSE ts_us END AS us, symbol || 'USDT' AS name FROM ticks")
def clock_units(spark, folder):
    t = ticks(spark, folder)
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.floor(F.col("ts_us") / 1_000_000)).when(k == 1, F.floor(F.col("ts_us") / 1000)).when(k == 2, F.col("ts_us")).otherwise(F.col("ts_us") * 1000)
    d = t.withColumns({"raw": raw, "text": F.concat(F.lit(" "), F.lower("symbol"), F.lit("/usdt"))})
    return d.select("event_id", N.clock_unit("raw").alias("unit"), N.to_us("raw").alias("us"), N.symbol_name("text").alias("name"))


@query("raw_envelope", "A16", f"WITH {TICKS} SELECT event_id, '{{\"event_id\":' || event_id || ',\"symbol\":\"' || symbol || '\"}}' AS raw_payload, 'feed' AS source FROM ticks")
def raw_envelope(spark, folder):
    return N.envelope(ticks(spark, folder).select("event_id", "symbol"), source="feed").select("event_id", "raw_payload", "source")


@query("positioning_merge", "A20", f"""WITH {TICKS}, a AS (SELECT symbol, ts_us // {6 * HOUR_US} AS slot, avg(price) AS top_ratio FROM ticks WHERE kind = 'view' GROUP BY 1, 2), b AS (SELECT symbol, ts_us // {6 * HOUR_US} AS slot, avg(price) AS crowd_ratio FROM ticks WHERE kind = 'click' GROUP BY 1, 2), c AS (SELECT symbol, ts_us // {6 * HOUR_US} AS slot, CAST(sum(qty) AS BIGINT) AS oi FROM ticks WHERE kind = 'error' GROUP BY 1, 2)
SELECT symbol, slot, top_ratio, crowd_ratio, oi FROM a FULL JOIN b USING (symbol, slot) FULL JOIN c USING (symbol, slot)""", "top_ratio crowd_ratio")
def positioning_merge(spark, folder):
    t = ticks(spark, folder).withColumn("slot", F.floor(F.col("ts_us") / (6 * HOUR_US)))
    one = lambda k, agg: t.where(F.col("kind") == k).groupBy("symbol", "slot").agg(agg)
    return N.full_outer([one("view", F.avg("price").alias("top_ratio")), one("click", F.avg("price").alias("crowd_ratio")), one("error", F.sum("qty").alias("oi"))], ["symbol", "slot"])


@query("part_manifest", "A17", f"WITH {TICKS} SELECT 'trades' AS stream, count(*) AS n_rows, min(ts_us) AS first, max(ts_us) AS last FROM ticks")
def part_manifest(spark, folder):
    t = ticks(spark, folder).withColumn("received", F.col("ts_us") + F.col("qty") * 1000)
    return sinks.append_part(t, sinks.scratch(spark, "manifest"), "trades", "ts_us", "received").select("stream", "n_rows", "first", "last")


@query("file_fingerprints", "A23")
def file_fingerprints(spark, folder):
    """Size and digest of every file of the tables, read by ranges."""
    f = archives.file_digests(archives.range_digests(spark, folder))
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "digest")


MANIFEST_RANGE = 2000
_LINE = "event_id || ',' || ts_us || ',' || qty"
_VER = f"""{TICKS}, l AS (SELECT symbol, event_id, {_LINE} AS line FROM ticks), w AS (SELECT *, CASE WHEN event_id % 97 = 5 AND symbol < 'S08' THEN line || '!' ELSE line END AS line2 FROM l),
o AS (SELECT *, sum(length(line) + 1) OVER x - length(line) - 1 AS at1, sum(length(line2) + 1) OVER x - length(line2) - 1 AS at2 FROM w WINDOW x AS (PARTITION BY symbol ORDER BY event_id)),
p AS (SELECT symbol, at1 // {MANIFEST_RANGE} AS range, string_agg(at1 || ':' || line, ';' ORDER BY event_id) AS h FROM o WHERE symbol <> 'S05' GROUP BY 1, 2), q AS (SELECT symbol, at2 // {MANIFEST_RANGE} AS range, string_agg(at2 || ':' || line2, ';' ORDER BY event_id) AS h FROM o WHERE symbol <> 'S11' GROUP BY 1, 2),
j AS (SELECT coalesce(p.symbol, q.symbol) AS symbol, coalesce(p.range, q.range) AS range, p.h AS a, q.h AS b FROM p FULL JOIN q ON p.symbol = q.symbol AND p.range = q.range)"""


@query("manifest_verification", "A24", f"""WITH {_VER} SELECT symbol, CASE WHEN count(b) = 0 THEN 'missing' WHEN count(a) = 0 THEN 'unknown' ELSE 'changed' END AS status, count(*) FILTER (a IS DISTINCT FROM b) AS n_ranges, min(range) FILTER (a IS DISTINCT FROM b) AS first_range
 FROM j GROUP BY 1 HAVING count(*) FILTER (a IS DISTINCT FROM b) > 0""")
def manifest_verification(spark, folder):
    """A tree of one file a symbol against its manifest, after some lines changed, a file was lost and another came."""
    t = ticks(spark, folder)
    line = F.concat_ws(",", "event_id", "ts_us", "qty")
    found = []
    for k, keep, text in (("manifest", "symbol <> 'S05'", line), ("now", "symbol <> 'S11'", F.when((F.col("event_id") % 97 == 5) & (F.col("symbol") < "S08"), F.concat(line, F.lit("!"))).otherwise(line))):
        path = sinks.scratch(spark, k)
        t.where(keep).select("symbol", "event_id", text.alias("value")).repartition("symbol").sortWithinPartitions("symbol", "event_id").select("symbol", "value").write.partitionBy("symbol").text(path)
        d = archives.range_digests(spark, path, MANIFEST_RANGE)
        found.append(d.withColumn("path", F.regexp_extract("path", "symbol=([^/]+)", 1)))
    d = archives.verify_manifest(*found)
    return d.select(F.col("path").alias("symbol"), "status", F.size("ranges").cast("bigint").alias("n_ranges"), F.array_min("ranges").alias("first_range"))


@query("archived_klines", "A11", f"""WITH {BARS} SELECT symbol, bar AS open_time, bar + {HOUR_US} - 1000 AS close_time, open, high, low, close, volume, quote_volume, trades, taker_buy_base, taker_buy_quote FROM bars""", "open high low close volume quote_volume trades taker_buy_base taker_buy_quote")
def archived_klines(spark, folder):
    """Hourly bars written as one archive a symbol, two members and more each, and read back member by member."""
    text = lambda x: F.col(x).cast("string")
    ms = lambda x: F.floor(x / 1000).cast("string")
    cols = [ms(F.col("bar")), text("open"), text("high"), text("low"), text("close"), text("volume"), ms(F.col("bar") + HOUR_US - 1000), text("quote_volume"), text("trades"), text("taker_buy_base"), text("taker_buy_quote"), F.lit("0")]
    b = bars(spark, folder).select("symbol", *[x.alias(k) for x, k in zip(cols, N.KLINE, strict=True)])
    path = sinks.scratch(spark, "archives")
    archives.write_archives(b, path, "symbol", list(N.KLINE), per_member=50)
    d = archives.archived_klines(spark, path)
    return d.select(F.regexp_extract("member", "^(S[0-9]+)-", 1).alias("symbol"), "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")


@query("document_upsert", "A18", """WITH a AS (SELECT doc_id, lang, source, n_chars AS payload, 1 AS v FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, lang, source, n_chars + 1, 2 FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, lang, source, n_chars + 1, 2 FROM documents WHERE doc_id % 3 > 0)
SELECT sha256(concat_ws('|', coalesce(source, 'null'), coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS doc_key, any_value(lang) AS lang, arg_max(payload, v) AS payload, max(v) AS version FROM a GROUP BY 1""")
def document_upsert(spark, folder):
    """Two batches, the second one sent twice: each document once, by the digest of its content, in its newest form."""
    d = read(spark, folder, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("payload"))
    path = sinks.scratch(spark, "documents")
    first = d.where("doc_id % 3 < 2").withColumn("version", F.lit(1))
    second = d.where("doc_id % 3 > 0").withColumns({"payload": F.col("payload") + 1, "version": F.lit(2)})
    for batch in (first, second, second):
        sinks.upsert_documents(batch, path, ["source", "doc_id"], ["lang"], ["version"])
    return readers.tree(spark, path).select("doc_key", "lang", "payload", "version")


@query("dataset_registry", "A26", f"WITH {TICKS} SELECT 'ticks' AS dataset, count(*) AS n_rows, min(ts_us) AS first, max(ts_us) AS last FROM ticks UNION ALL SELECT 'orders', count(*), min(epoch_us(o_orderdate)), max(epoch_us(o_orderdate)) FROM orders")
def dataset_registry(spark, folder):
    a = readers.registry_row(ticks(spark, folder), "ticks", F.col("ts_us"))
    b = readers.registry_row(read(spark, folder, "orders"), "orders", epoch_us("o_orderdate"))
    return a.unionByName(b).drop("schema_digest")


# --- streams -------------------------------------------------------------------------------------


FAR_US = 4_000_000_000_000_000


def tick_stream(spark, folder, disorder_us=0):
    """The trades as a stream of several files: in order of their clock, or up to ``disorder_us`` late and flushed at the end."""
    e = S.replay(tick_table(spark, folder), "ts_us", disorder_us, {"ts_us": FAR_US, "kind": "error", "qty": -1} if disorder_us else None)
    return e.withColumn("ts", F.timestamp_micros("ts_us"))


def tick_table(spark, folder):
    e = read(spark, folder, "events").where("value > 0")
    return e.select("event_id", epoch_us("ts").alias("ts_us"), F.concat(F.lit("S"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("symbol"),
                    F.col("event_type").alias("kind"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("qty"), "props")


@query("stream_event_clusters", "S11 S10", f"SELECT epoch_us(ts) // 300000000 * 300000000 AS start_us, {_SYM} AS symbol, count(*) AS n FROM events WHERE event_type = 'error' AND value > 0 GROUP BY 1, 2")
def stream_event_clusters(spark, folder):
    return S.drain(S.windowed_counts(tick_stream(spark, folder, 12 * HOUR_US).where("kind = 'error'"), "ts", ["symbol"], "5 minutes"))


@query("stream_sliding_counts", "S10", f"SELECT (epoch_us(ts) // {HOUR_US} - k) * {HOUR_US} AS start_us, {_SYM} AS symbol, count(*) AS n FROM events, (SELECT unnest(range(6)) AS k) WHERE value > 0 GROUP BY 1, 2")
def stream_sliding_counts(spark, folder):
    return S.drain(S.windowed_counts(tick_stream(spark, folder, 12 * HOUR_US), "ts", ["symbol"], "6 hours", "1 hour"))


@query("stream_sessions", "S10 K33", f"""WITH {TICKS}, g AS (SELECT symbol, ts_us, CASE WHEN ts_us - lag(ts_us) OVER w >= {HOUR_US} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_us)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts_us) AS k FROM g)
SELECT min(ts_us) AS start_us, symbol, count(*) AS n FROM s GROUP BY symbol, k""")
def stream_sessions(spark, folder):
    return S.drain(S.gap_sessions(tick_stream(spark, folder, 12 * HOUR_US), "ts", ["symbol"], "1 hour"))


@query("stream_dedupe", "S8", "SELECT count(DISTINCT (user_id % 16, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT))) AS n FROM events WHERE value > 0")
def stream_dedupe(spark, folder):
    d = S.drain(S.first_seen(tick_stream(spark, folder), "ts", ["symbol", "qty"], "60 days").select("symbol", "qty"))
    return d.agg(F.count(F.lit(1)).alias("n"))


@query("stream_dead_letters", "S2 S3 S4", f"SELECT {_SYM} AS symbol, count(*) FILTER (event_id % 7 <> 0) AS valid, count(*) FILTER (event_id % 7 = 0) AS dead FROM events WHERE value > 0 GROUP BY 1")
def stream_dead_letters(spark, folder):
    t = tick_stream(spark, folder).select("symbol", F.when(F.col("event_id") % 7 == 0, F.lit('{"x": 1}')).otherwise(F.col("props")).alias("text"))
    valid, dead = S.split_dead_letters(t, "text", "k bigint", ["k"])
    a = S.drain(valid, parts=["symbol"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("valid"))
    b = S.drain(dead).groupBy("symbol").agg(F.count(F.lit(1)).alias("dead"))
    return a.join(b, "symbol", "full").select("symbol", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("dead", F.lit(0)).alias("dead"))


@query("stream_book_messages", "S1", f"""WITH {TICKS} SELECT ['a', 'b', 'c', 'd'][event_id % 4 + 1] AS venue, symbol || 'USDT' AS symbol, ts_us // 1000 * 1000 AS event_us, s AS side, CASE s WHEN 'bid' THEN price ELSE price + 1 END AS price, CAST(qty AS DOUBLE) AS qty FROM ticks, (SELECT unnest(['bid', 'ask']) AS s)""", "price qty")
def stream_book_messages(spark, folder):
    k = F.col("event_id") % 4
    lv = lambda add: F.array(F.array((F.col("price") + add).cast("string"), F.col("qty").cast("string")))
    nd = lambda add: F.array(F.struct((F.col("price") + add).cast("string").alias("px"), F.col("qty").cast("string").alias("sz")))
    ms, name = F.floor(F.col("ts_us") / 1000), F.concat("symbol", F.lit("-USDT"))
    add = F.lit(1.0)
    a = F.to_json(F.struct(name.alias("s"), ms.alias("E"), lv(F.lit(0.0)).alias("b"), lv(add).alias("a")))
    b = F.to_json(F.struct(ms.alias("ts"), F.struct(name.alias("s"), lv(F.lit(0.0)).alias("b"), lv(add).alias("a")).alias("data")))
    cc = F.to_json(F.struct(F.struct(name.alias("instId")).alias("arg"), F.array(F.struct(ms.cast("string").alias("ts"), lv(F.lit(0.0)).alias("bids"), lv(add).alias("asks"))).alias("data")))
    d = F.to_json(F.struct(name.alias("coin"), ms.alias("time"), F.array(nd(F.lit(0.0)), nd(add)).alias("levels")))
    venue = F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (k + 1).cast("int"))
    t = tick_stream(spark, folder).select(venue.alias("venue"), F.when(k == 0, a).when(k == 1, b).when(k == 2, cc).otherwise(d).alias("text"))
    return S.drain(S.book_messages(t, "venue", "text"))


@query("stream_suppressed_triggers", "S14", f"""WITH RECURSIVE {TICKS}, t AS (SELECT symbol, ts_us FROM ticks WHERE kind = 'error'), k AS (SELECT symbol, min(ts_us) AS ts_us FROM t GROUP BY symbol UNION ALL SELECT k.symbol, (SELECT min(t.ts_us) FROM t WHERE t.symbol = k.symbol AND t.ts_us >= k.ts_us + {6 * HOUR_US}) FROM k WHERE k.ts_us IS NOT NULL)
SELECT symbol, ts_us FROM k WHERE ts_us IS NOT NULL""")
def stream_suppressed_triggers(spark, folder):
    return S.drain(S.suppressed_triggers(tick_stream(spark, folder).where("kind = 'error'"), "symbol", "ts_us", 6 * HOUR_US))


@query("stream_sequence_gaps", "S5", f"WITH {TICKS}, g AS (SELECT symbol, ts_us, event_id, event_id - lag(event_id) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) - 1 AS hole FROM ticks) SELECT symbol, ts_us, event_id, hole FROM g WHERE hole <> 0")
def stream_sequence_gaps(spark, folder):
    return S.drain(S.sequence_gaps(tick_stream(spark, folder), "symbol", "ts_us", "event_id"))


@query("stream_forced_flow_enrich", "S12", f"WITH {TICKS}, b AS (SELECT symbol, ts_us, price FROM ticks WHERE kind = 'view') SELECT l.symbol, l.event_id, l.ts_us, b.price AS book FROM (SELECT * FROM ticks WHERE kind = 'error') l ASOF LEFT JOIN b ON b.symbol = l.symbol AND l.ts_us >= b.ts_us", "book")
def stream_forced_flow_enrich(spark, folder):
    t = tick_stream(spark, folder).where("kind in ('error', 'view')").withColumn("liq", F.col("kind") == "error")
    return S.drain(S.latest_enrich(t, "symbol", "ts_us", "liq", "event_id", "price"))


@query("stream_late_rows", "S17 S9", f"WITH {TICKS} SELECT symbol, count(*) AS n, count(*) FILTER (qty > 80) AS n_late, max(qty * 1000000) AS lag_max FROM ticks GROUP BY 1")
def stream_late_rows(spark, folder):
    t = tick_stream(spark, folder).withColumn("received", F.col("ts_us") + F.col("qty") * 1_000_000)
    return S.drain(S.late_report(t, "ts", "received", ["symbol"], 80_000_000), "complete")


@query("stream_equity_alerts", "S19 S18", f"""WITH {TICKS}, e AS (SELECT *, price - 60 AS pnl, row_number() OVER w AS i, sum(price - 60) OVER w AS eq FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id)), d AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY i), 0) - eq AS fall, i - coalesce(max(CASE WHEN pnl >= 0 THEN i END) OVER (PARTITION BY symbol ORDER BY i), 0) AS losses FROM e)
SELECT symbol, event_id, ts_us, fall, losses FROM d WHERE fall > 3000 OR losses >= 12""", "fall")
def stream_equity_alerts(spark, folder):
    return S.drain(S.equity_alerts(tick_stream(spark, folder).withColumn("pnl", F.col("price") - 60), "symbol", "ts_us", "event_id", "pnl", 3000.0, 12))


@query("stream_drift_monitor", "S18 F19", f"""WITH RECURSIVE {TICKS}, x AS (SELECT symbol, event_id, ts_us, CASE WHEN price > 50 THEN 1.0 ELSE 0 END AS h, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS i FROM ticks), e AS (SELECT symbol, event_id, ts_us, i, h::DOUBLE AS rate FROM x WHERE i = 1 UNION ALL SELECT x.symbol, x.event_id, x.ts_us, x.i, e.rate + 0.05 * (x.h - e.rate) FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)
SELECT symbol, event_id, ts_us, rate FROM e WHERE rate < 0.25""", "rate")
def stream_drift_monitor(spark, folder):
    t = tick_stream(spark, folder).withColumn("hit", F.when(F.col("price") > 50, 1.0).otherwise(0.0))
    return S.drain(S.drift_monitor(t, "symbol", "ts_us", "event_id", "hit", 0.05, 0.25))
