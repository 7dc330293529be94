"""Structured Streaming jobs over files of events.

Each job is a transformation of a stream; ``drain`` runs it to the end of the available
input, exactly once, with its state under the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import c, ind
from tidemark.session import pin
from tidemark.sources.sinks import scratch


#: Rows a replayed file holds at least, once a batch has more than one.
FILE_ROWS = 50_000
#: Rows that a task makes from packed ones, and tasks at most.
TASK_ROWS, TASKS = 2_000_000, 4096


def replay(df: DataFrame, clock: str, disorder_us: int = 0, flush: dict | None = None, rows: int = 5_000_000, files: int = 32) -> DataFrame:
    """A table as a stream of about four batches or more, in order of ``clock`` (microseconds).

    ``disorder_us``: rows come up to so much late, after rows with a later clock. ``flush``: columns of a last row, which
    moves the watermark past everything before it. A batch holds about ``rows`` rows, dealt evenly to the same number of
    files (``files`` at most), so that many tasks write and read it; a trigger takes just one batch.
    """
    spark = df.sparkSession
    path, stage = scratch(spark, "replay"), scratch(spark, "replay-stage")
    late = F.pmod(F.xxhash64(*df.columns), F.lit(disorder_us + 1)) if disorder_us else F.lit(0)
    d = pin(df.withColumn("arrives_", c(clock) + late))
    n = d.count()
    count = max(4, -(-n // rows))
    cuts = d.agg(F.percentile_approx("arrives_", F.array(*[F.lit(k / count) for k in range(1, count)]), F.lit(100 * count))).first()[0] or []
    edges = F.array(*[F.lit(x).cast("bigint") for x in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    d = d.withColumn("batch_", F.size(F.filter(edges, lambda e: e <= F.col("arrives_"))))
    d.drop("arrives_").write.partitionBy("batch_").parquet(stage)
    # a batch without rows has no files, the others have equally many: a batch without enough rows to deal lowers them all
    sizes = {r.batch_: r.n for r in d.groupBy("batch_").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, min([files, *[size // FILE_ROWS for size in sizes.values()]]))
    for k in sorted(sizes):
        part = spark.read.schema(df.schema).parquet(f"{stage}/batch_={k}")
        (part.repartition(each) if each > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    if not sizes:
        spark.createDataFrame([], df.schema).coalesce(1).write.parquet(path)
    if flush is not None:
        last = d.select(*[F.lit(flush[x]).cast(f.dataType).alias(x) if x in flush else c(x) for x, f in zip(df.columns, df.schema.fields, strict=True)]).limit(1)
        last.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def drain(stream: DataFrame, mode: str = "append", parts: Sequence[str] = ()) -> DataFrame:
    """Run the stream over what is available and return what it wrote."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    if mode == "append":
        w = stream.writeStream.outputMode("append").format("parquet").option("path", out)
        w = w.partitionBy(*parts) if parts else w
    else:
        # The whole result replaces the former one, so a repeated batch changes nothing.
        w = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    w.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def spread(packed: DataFrame, rows: str | Column) -> DataFrame:
    """Rows that each stand for many (``rows``), dealt evenly to tasks by how many they stand for in all."""
    total = packed.agg(F.sum(rows)).first()[0] or 0
    return packed.repartition(max(1, min(TASKS, -(-total // TASK_ROWS))))


def pieces(packed: DataFrame, place: str, size: int, *columns: str) -> DataFrame:
    """Each row as several that hold ``size`` elements of the arrays ``columns``, from ``place`` (0 at first) on."""
    d = packed.withColumn(place, F.explode(F.sequence(F.lit(0), F.greatest(F.size(columns[0]) - 1, F.lit(0)), F.lit(size))))
    return d.withColumns({x: F.slice(x, F.col(place) + 1, F.lit(size)) for x in columns})


def step(df: DataFrame) -> DataFrame:
    """The same rows and partitions. All that explodes make of a row is held in memory until a step between them or the end takes it."""
    return df.coalesce(TASKS)


def split_dead_letters(stream: DataFrame, text: str, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, dead): parsed messages that carry all required fields, and the raw text of the others."""
    d = stream.withColumn("_m", F.from_json(c(text), schema))
    ok = F.col("_m").isNotNull()
    for r in required:
        ok = ok & F.col(f"_m.{r}").isNotNull()
    return d.where(ok).select(*[x for x in stream.columns if x != text], "_m.*"), d.where(~ok).select(*stream.columns)


def book_messages(stream: DataFrame, venue: str, text: str) -> DataFrame:
    """Level updates (venue, symbol, event_us, side, price, qty) from each venue's message shape.

    Shapes: a: {s, E, b: [[p, q]], a: [[p, q]]}; b: {topic, ts, data: {s, b, a}};
    c: {arg: {instId}, data: [{ts, bids, asks}]}; d: {coin, time, levels: [[{px, sz}], [{px, sz}]]}.
    """
    pair = "array<array<string>>"
    node = "array<array<struct<px: string, sz: string>>>"
    j = lambda s: F.from_json(c(text), s)
    d = stream.withColumns({
        "_a": j(f"s string, E bigint, b {pair}, a {pair}"), "_b": j(f"ts bigint, data struct<s: string, b: {pair}, a: {pair}>"),
        "_c": j(f"arg struct<instId: string>, data array<struct<ts: string, bids: {pair}, asks: {pair}>>"), "_d": j(f"coin string, time bigint, levels {node}")})
    flat = lambda arr: F.transform(arr, lambda v: F.array(v["px"], v["sz"]))
    first = F.try_element_at("_c.data", F.lit(1))
    pick = lambda a, b, x, y: F.when(c(venue) == "a", a).when(c(venue) == "b", b).when(c(venue) == "c", x).when(c(venue) == "d", y)
    d = d.select(
        c(venue).alias("venue"), F.upper(F.regexp_replace(pick(c("_a.s"), c("_b.data.s"), c("_c.arg.instId"), c("_d.coin")), "[/-]", "")).alias("symbol"),
        (pick(c("_a.E"), c("_b.ts"), first["ts"].try_cast("bigint"), c("_d.time")) * 1000).alias("event_us"),
        pick(c("_a.b"), c("_b.data.b"), first["bids"], flat(F.try_element_at("_d.levels", F.lit(1)))).alias("bid"),
        pick(c("_a.a"), c("_b.data.a"), first["asks"], flat(F.try_element_at("_d.levels", F.lit(2)))).alias("ask"))
    side = lambda s: F.transform(F.coalesce(c(s), F.array().cast(pair)), lambda v: F.struct(F.lit(s).alias("side"), v[0].try_cast("double").alias("price"), v[1].try_cast("double").alias("qty")))
    d = d.withColumn("_l", F.explode(F.concat(side("bid"), side("ask"))))
    return d.select("venue", "symbol", "event_us", "_l.*").where("symbol is not null and price > 0 and qty >= 0")


def windowed_counts(stream: DataFrame, clock: str, keys: Sequence[str], width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    w = F.window(clock, width, slide) if slide else F.window(clock, width)
    d = stream.withWatermark(clock, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.unix_micros("window.start").alias("start_us"), *keys, "n")


def gap_sessions(stream: DataFrame, clock: str, keys: Sequence[str], gap: str, late: str = "1 day") -> DataFrame:
    d = stream.withWatermark(clock, late).groupBy(F.session_window(clock, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.unix_micros("session_window.start").alias("start_us"), *keys, "n")


def first_seen(stream: DataFrame, clock: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(clock, late).dropDuplicatesWithinWatermark(list(keys))


def late_report(stream: DataFrame, clock: str, received: str, keys: Sequence[str], limit_us: int) -> DataFrame:
    """Counts of fresh and late rows by the distance of the two clocks."""
    lag = c(received) - F.unix_micros(c(clock))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(ind(lag > limit_us)).cast("bigint").alias("n_late"), F.max(lag).alias("lag_max"))


def stateful(stream: DataFrame, key: str, order: Sequence[str], out: str, state: str, step: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]) -> DataFrame:
    """Per key, ``step(state, ordered rows) -> (state, output rows)`` on each batch."""
    order = list(order)

    def run(_, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        new, got = step(st.get if st.exists else None, rows)
        st.update(new)
        yield got

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def suppressed_triggers(stream: DataFrame, key: str, clock: str, gap: int) -> DataFrame:
    """Rows that fire: none fires within ``gap`` of the last that did for its key."""
    def step(state, rows):
        last = state[0] if state else None
        t = rows[clock].to_numpy("int64")
        keep, i = [], 0 if last is None else int(np.searchsorted(t, last + gap))
        while i < len(t):
            keep.append(i)
            last = int(t[i])
            i = int(np.searchsorted(t, last + gap))
        return (last,), rows.iloc[keep][[key, clock]]

    kt = stream.schema[key].dataType.simpleString()
    return stateful(stream.select(key, clock), key, [clock], f"{key} {kt}, {clock} bigint", "last bigint", step)


def sequence_gaps(stream: DataFrame, key: str, clock: str, seq: str) -> DataFrame:
    """Rows whose update number does not follow the one before, with the size of the hole."""
    def step(state, rows):
        v = rows[seq].to_numpy("int64")
        prev = np.concatenate(([state[0] if state else v[0] - 1], v[:-1]))
        hole = v - prev - 1
        bad = rows[[key, clock, seq]].assign(hole=hole)[hole != 0]
        return (int(v[-1]),), bad

    kt = stream.schema[key].dataType.simpleString()
    return stateful(stream.select(key, clock, seq), key, [clock, seq], f"{key} {kt}, {clock} bigint, {seq} bigint, hole bigint", "last bigint", step)


def latest_enrich(stream: DataFrame, key: str, clock: str, is_event: str, ident: str, value: str) -> DataFrame:
    """Event rows with the newest value row of their key at or before them."""
    def step(state, rows):
        seen = rows[value].where(~rows[is_event])
        if state and state[0] is not None:
            seen = pd.concat([pd.Series([state[0]]), seen]).ffill().iloc[1:]
        else:
            seen = seen.ffill()
        out = rows.assign(book=seen.to_numpy())
        last = seen.iloc[-1]
        return (None if pd.isna(last) else float(last),), out[out[is_event]][[key, ident, clock, "book"]]

    kt = stream.schema[key].dataType.simpleString()
    d = stream.select(key, ident, clock, is_event, value)
    return stateful(d, key, [clock, ident], f"{key} {kt}, {ident} bigint, {clock} bigint, book double", "last double", step)


def equity_alerts(stream: DataFrame, key: str, clock: str, ident: str, pnl: str, drawdown: float, streak: int) -> DataFrame:
    """Rows where the fall from the running peak or the run of losses passes its limit."""
    def step(state, rows):
        total, peak, run = state if state else (0.0, 0.0, 0)
        p = rows[pnl].to_numpy("float64")
        eq = total + p.cumsum()
        top = np.maximum.accumulate(np.concatenate(([peak], eq)))[1:]
        loss = p < 0
        place = np.arange(len(p))
        last_gain = np.maximum.accumulate(np.where(loss, -1, place))
        runs = np.where(last_gain >= 0, place - last_gain, run + place + 1)
        runs = np.where(loss, runs, 0)
        out = rows[[key, ident, clock]].assign(fall=top - eq, losses=runs.astype("int64"))
        return (float(eq[-1]), float(top[-1]), int(runs[-1])), out[(out["fall"] > drawdown) | (out["losses"] >= streak)]

    kt = stream.schema[key].dataType.simpleString()
    return stateful(stream.select(key, ident, clock, pnl), key, [clock, ident], f"{key} {kt}, {ident} bigint, {clock} bigint, fall double, losses bigint",
                    "total double, peak double, run bigint", step)


def drift_monitor(stream: DataFrame, key: str, clock: str, ident: str, hit: str, alpha: float, floor: float) -> DataFrame:
    """Running hit rate (exponential weights) per key; rows where it lies below ``floor``."""
    def step(state, rows):
        x = rows[hit].astype("float64")
        if state:
            x = pd.concat([pd.Series([state[0]]), x])
        e = x.ewm(alpha=alpha, adjust=False).mean()
        e = e.iloc[1:] if state else e
        out = rows[[key, ident, clock]].assign(rate=e.to_numpy())
        return (float(e.iloc[-1]),), out[out["rate"] < floor]

    kt = stream.schema[key].dataType.simpleString()
    return stateful(stream.select(key, ident, clock, hit), key, [clock, ident], f"{key} {kt}, {ident} bigint, {clock} bigint, rate double", "rate double", step)


def versioned_changes(stream: DataFrame, poll: str, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Changes between successive full listings of a stream: names added and removed, and each field that differs.

    ``poll`` numbers the listings; a listing comes whole in one batch, and one batch may hold several. The first listing
    is the baseline. Each batch reads the newest listing that an earlier batch left and writes its changes and its own
    newest listing under its number, so a batch that is repeated replaces its own rows and changes nothing else.
    """
    spark = stream.sparkSession
    base, state = scratch(spark, "listings"), scratch(spark, "stream-state")
    step, rows = listing_step(stream, base, poll, key, fields)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*rows.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/changes").drop("batch")


def listing_step(stream: DataFrame, base: str, poll: str, key: Sequence[str], fields: Sequence[str]) -> tuple[Callable, T.StructType]:
    """What one batch does, and the schema of the changes below ``base``."""
    spark, key = stream.sparkSession, list(key)
    kept = T.StructType(list(stream.schema.fields))
    rows = T.StructType([*[stream.schema[k] for k in key], T.StructField(poll, stream.schema[poll].dataType), *[T.StructField(x, T.StringType()) for x in ("change", "field", "old", "new")]])
    # folders with a schema from the start, also for a stream without any change
    for path, kind in ((f"{base}/changes/batch=-1", rows), (f"{base}/latest/batch=-1", kept)):
        spark.createDataFrame([], kind).write.parquet(path)

    def step(df: DataFrame, number: int) -> None:
        df = pin(df.select(*kept.names))
        left = spark.read.schema(T.StructType([*kept.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/latest").where(F.col("batch") < number)
        newest = left.agg(F.max("batch")).first()[0]
        both = df.unionByName(left.where(F.col("batch") == newest).drop("batch")) if newest is not None else df
        polls = pin(both.select(poll).distinct())
        order = Window.orderBy(poll)  # as many rows as listings in one batch
        before = both.join(polls.withColumn("next_", F.lead(poll).over(order)).where("next_ IS NOT NULL"), poll).drop(poll).withColumnRenamed("next_", poll)
        after = both.join(polls.withColumn("prev_", F.lag(poll).over(order)).where("prev_ IS NOT NULL").drop("prev_"), poll, "left_semi")
        snapshot_changes(before, after, [*key, poll], fields).write.mode("overwrite").parquet(f"{base}/changes/batch={number}")
        top = polls.agg(F.max(poll)).first()[0]
        if top is not None:
            both.where(F.col(poll) == top).write.mode("overwrite").parquet(f"{base}/latest/batch={number}")

    return step, rows


def snapshot_changes(before: DataFrame, after: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, change, field, old, new) between two sides of any number of listings."""
    key = list(key)
    old = before.select(*key, F.lit(True).alias("_a"), *[c(f).cast("string").alias(f"a_{f}") for f in fields])
    new = after.select(*key, F.lit(True).alias("_b"), *[c(f).cast("string").alias(f"b_{f}") for f in fields])
    none = F.lit(None).cast("string")
    row = lambda kind, f, o, n: F.struct(F.lit(kind).alias("change"), F.lit(f).alias("field"), o.alias("old"), n.alias("new"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    found = [F.when(F.col("_a").isNull(), row("symbol_added", "", none, none)), F.when(F.col("_b").isNull(), row("symbol_removed", "", none, none))]
    found += [F.when(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), row(f"{f}_changed", f, F.col(f"a_{f}"), F.col(f"b_{f}"))) for f in fields]
    return old.join(new, key, "full").select(*key, F.explode(F.array_compact(F.array(*found))).alias("r")).select(*key, "r.*")
