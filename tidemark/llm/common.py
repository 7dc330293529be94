"""Tables, scratch tables in the shared folder, word splitting and hashes that every task computes alike."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: A word: a run of anything but ASCII space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch at most: batches hold whole texts, and a task keeps what its largest batch took.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches hold BATCH_ROWS rows at most. A lower setting is kept."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id, modulus: int) -> F.Column:
    """crc32 of the id's decimal text, mod ``modulus``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


# Fixed odd multipliers of the polynomial hashes, one pair for each lane.
BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... mod 2**64."""
    if len(POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 1 << 22:
            return out
        POWERS[base] = out
    return POWERS.get(base, np.zeros(0, np.uint64))[:n]


def window_sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:stop], for all ranges at once, free of their place (mod 2**64)."""
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[stop] - total[start]) * powers(inverse, len(values) + 1)[start]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of many texts (Arrow string array), hashed at once.

    ``start``/``stop`` are byte ranges in ``data``; words ``first[i]`` to ``first[i + 1]`` are those of text i.
    """

    def __init__(self, texts, lower: bool = False, lanes: int = 1):
        import pyarrow as pa

        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        if lower:
            data = LOWER[data]
        inside = ~SPACE[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = bounds[(bounds > 0) & (bounds < len(data))]
        opens[edge] |= inside[edge]
        closes[edge - 1] |= inside[edge - 1]
        self.data, self.start, self.stop = data, np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        size = (self.stop - self.start).astype(np.uint64)
        self.hashes = [np.zeros(len(size), np.uint64) for _ in range(lanes)]
        at = 0
        while at < len(size):  # a megabyte at a time
            to = max(at + 1, int(np.searchsorted(self.stop, self.start[at] + (1 << 20))))
            base = self.start[at]
            seen = data[base:self.stop[to - 1]].astype(np.uint64) + np.uint64(1)
            for out, (a, b) in zip(self.hashes, BASES, strict=False):
                out[at:to] = mix(window_sums(seen, self.start[at:to] - base, self.stop[at:to] - base, a) + size[at:to] * np.uint64(b))
            at = to

    def windows(self, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of k words within one text, and the first windows of the texts."""
        counts = np.maximum(np.diff(self.first) - k + 1, 0)
        at = ranges(self.first[:-1], counts)
        return mix(window_sums(self.hashes[lane], at, at + k, BASES[lane][1])), np.concatenate([[0], np.cumsum(counts)])


def ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... (counts[i] of them), for each i in turn."""
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(begin, counts)


def pieces(table, column: str, limit: int):
    """Slices of an Arrow table whose texts hold about ``limit`` bytes each, so that long texts do not add up."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < table.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield table.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Hands memory that is free in this Python worker back to the machine: a worker lives on and would keep what its largest batch took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


ID_LAST = (1 << 63) - 1


def id_key(column) -> F.Column:
    """The id as a whole number that sorts; null comes last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(ID_LAST))


def dealt(buckets: np.ndarray, owner: np.ndarray, *keys: np.ndarray):
    """Keys by bucket: (bucket, owners, how many keys each owner has, keys) for each bucket with any. An owner's keys stand side by side."""
    order = np.argsort(buckets, kind="stable")
    buckets, owner, keys = buckets[order], owner[order], [x[order] for x in keys]
    if not len(buckets):
        return
    edge = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    run = np.flatnonzero(np.concatenate([[True], (buckets[1:] != buckets[:-1]) | (owner[1:] != owner[:-1])]))
    size = np.diff(np.concatenate([run, [len(buckets)]]))
    ends = np.concatenate([edge, [len(buckets)]])
    at = np.searchsorted(run, ends)
    for i, b in enumerate(buckets[edge].tolist()):
        mine = slice(at[i], at[i + 1])
        yield b, owner[run[mine]], size[mine], *[x[ends[i]:ends[i + 1]] for x in keys]


def grouped(batches, column: str):
    """Consecutive rows of one value of ``column``, as (value, iterator of row dictionaries)."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from batch.to_pylist()
        give_back()

    return groupby(rows(), key=lambda r: r[column])


def columns_of(df: DataFrame) -> str:
    """The schema as the DDL that mapInArrow takes."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def rest_of(df: DataFrame, text: str) -> F.Column:
    """All columns but the text as one struct, ``rest``, whatever they are called."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]).alias("rest")


def whole_rows(rows: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """Rows (text, rest) with the columns of ``df`` again."""
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])


#: Ids in a broadcast filter at most (some 100 MB); above that the same join runs by shuffle.
BROADCAST_IDS = 4_000_000


def only_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (distinct, stashed, one column of the same name)."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")
