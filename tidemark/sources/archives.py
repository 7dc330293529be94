"""Archives whose members are partitions, and digests of files by ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.scalars import c
from tidemark.session import pin
from tidemark.sources.normalise import KLINE, to_us

#: Bytes of a range, and rows of the block list that may be broadcast.
RANGE_BYTES, BLOCK_LIST = 64 << 20, 1_000_000


def opened(uri: str):
    """(file system, path) of a local path or of any address that Arrow knows."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), uri


# --- members of archives -------------------------------------------------------------------------


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class KlineArchives(DataSource):
    """``zipped_klines``: 12-column kline CSVs in the ZIP files below ``path``, with or without a header, as text columns.

    Each member of each archive is a partition. Only the archives' directories are read to list them; a task reads its
    member as a stream, a few megabytes at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_klines"

    def schema(self) -> str:
        return "archive string, member string, " + ", ".join(f"{k} string" for k in KLINE)

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options["path"], int(self.options.get("blockBytes", 4 << 20)))


class MemberReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self) -> Sequence[InputPartition]:
        import zipfile

        from pyarrow import fs

        system, root = opened(self.path)
        found = []
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if info.is_file and info.base_name.endswith(".zip"):
                with system.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                    found += [Member(info.path, m.filename) for m in z.infolist() if m.filename.endswith(".csv") and m.file_size]
        return found or [Member("", "")]

    def read(self, partition: Member) -> Iterator:
        import zipfile

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import csv

        if not partition.archive:
            return
        names = list(KLINE)
        system, _ = opened(self.path)
        with system.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            stream = csv.open_csv(member, csv.ReadOptions(column_names=names, block_size=self.block), convert_options=csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string())))
            for batch in stream:
                batch = batch.filter(pc.match_substring_regex(batch.column(0), r"^\d+$"))  # leaves a header out
                own = [pa.array([x] * batch.num_rows, pa.string()) for x in (partition.archive, partition.name)]
                yield pa.RecordBatch.from_arrays([*own, *batch.columns], names=["archive", "member", *names])


def archived_klines(spark: SparkSession, path: str) -> DataFrame:
    """The bars of all archives below ``path``, typed, clocks in microseconds whatever their unit."""
    spark.dataSource.register(KlineArchives)
    d = spark.read.format("zipped_klines").option("path", path).load()
    nums = [k for k in KLINE if k not in ("open_time", "close_time", "ignore")]
    return d.select("archive", "member", to_us(c("open_time").try_cast("bigint")).alias("open_time"), to_us(c("close_time").try_cast("bigint")).alias("close_time"), *[c(k).try_cast("double").alias(k) for k in nums])


def write_archives(bars: DataFrame, path: str, archive: str, columns: Sequence[str], per_member: int = 100_000) -> DataFrame:
    """One ZIP for each value of ``archive``, written by the tasks as streams; (archive, rows). The columns are texts, in KLINE order."""
    columns = list(columns)

    def write(batches: Iterator) -> Iterator:
        import zipfile
        from itertools import groupby

        import pyarrow as pa

        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        for name, own in groupby(rows, key=lambda r: r[0]):
            system, root = opened(path)
            n, out = 0, None
            with system.open_output_stream(f"{root}/{name}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for r in own:
                    if n % per_member == 0:
                        if out is not None:
                            out.close()
                        out = z.open(f"{name}-{n // per_member}.csv", "w")
                    out.write((",".join(r[1:]) + "\n").encode())
                    n += 1
                if out is not None:
                    out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "n_rows": n}])

    system, root = opened(path)
    system.create_dir(root)
    d = bars.select(c(archive).cast("string").alias("archive"), *columns)
    return pin(d.repartition("archive").sortWithinPartitions("archive", *columns[:1]).mapInArrow(write, "archive string, n_rows bigint"))


# --- digests by range ----------------------------------------------------------------------------


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` as runs of bytes up to a line feed, in order within a block of the file."""
    d = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("bytes"))


def range_digests(spark: SparkSession, path: str, width: int = RANGE_BYTES) -> DataFrame:
    """(path, size, range, digest): digests of the runs that begin in each ``width`` bytes of each file.

    A file of any size is read in parallel by Spark's own reader, from whatever store it reads. A run counts with its
    place in the file, and the counts of a range add up, so digests do not depend on how the file was split into blocks.
    """
    lines = raw_lines(spark, path)
    blocks = pin(lines.groupBy("path", "block").agg(F.sum(F.octet_length("bytes") + 1).alias("length")))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of a file
    begins = pin(blocks.select("path", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("begin")))
    # a join by broadcast keeps the order of the runs; a longer list of blocks goes in slices of the files
    slices = max(1, -(-blocks.count() // BLOCK_LIST))
    own = F.pmod(F.xxhash64("path"), F.lit(slices))
    placed = lines.where(own == 0).join(F.broadcast(begins.where(own == 0)), ["path", "block"])
    for i in range(1, slices):
        placed = placed.unionByName(lines.where(own == i).join(F.broadcast(begins.where(own == i)), ["path", "block"]))

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        now, at = None, 0
        for b in batches:
            sums: dict[tuple, list] = {}
            size = pc.binary_length(b.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            for p, whole, begin, n, raw in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), b.column("begin").to_pylist(), size.tolist(), b.column("bytes"), strict=True):
                if (p, begin) != now:
                    now, at = (p, begin), begin
                d = hashlib.sha256(b"%d:" % at + raw.as_buffer().to_pybytes()).digest()
                s = sums.setdefault((p, whole, at // width), [0, 0])
                s[0] += int.from_bytes(d[:7], "big")
                s[1] += int.from_bytes(d[7:14], "big")
                at += n
            mask = (1 << 56) - 1
            yield pa.RecordBatch.from_pylist([{"path": p, "size": w, "range": r, "a": x & mask, "b": y & mask} for (p, w, r), (x, y) in sums.items()], schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("range", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

    parts = placed.mapInArrow(digest, "path string, size bigint, range bigint, a bigint, b bigint")
    whole = parts.groupBy("path", "size", "range").agg(*[F.pmod(F.sum(F.col(x).cast("decimal(38,0)")), F.lit(1 << 56).cast("decimal(38,0)")).cast("bigint").alias(x) for x in "ab"])
    return whole.select("path", "size", "range", F.concat(F.lpad(F.lower(F.hex("a")), 14, "0"), F.lpad(F.lower(F.hex("b")), 14, "0")).alias("digest"))


def file_digests(ranges: DataFrame) -> DataFrame:
    """(path, size, digest) of each file from its ranges' digests."""
    return ranges.groupBy("path", "size").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("range").cast("string"), 12, "0"), "digest")))), 256).alias("digest"))


def verify_manifest(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status, ranges): files of the manifest that are missing or changed, files it does not know, and the changed ranges.

    Both sides are range digests.
    """
    key = ["path", "range"]
    a = manifest.select(*key, F.col("size").alias("was_size"), F.col("digest").alias("was"))
    b = now.select(*key, F.col("size").alias("is_size"), F.col("digest").alias("is"))
    d = a.join(b, key, "full")
    per = d.groupBy("path").agg(F.count("was").alias("old"), F.count("is").alias("new"), F.array_sort(F.collect_list(F.when(~F.col("was").eqNullSafe(F.col("is")), F.col("range")))).alias("ranges"))
    status = F.when(F.col("new") == 0, "missing").when(F.col("old") == 0, "unknown").when(F.size("ranges") > 0, "changed")
    return per.withColumn("status", status).where("status IS NOT NULL").select("path", "status", "ranges")
