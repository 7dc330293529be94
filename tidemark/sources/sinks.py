"""Writing: partitioned upserts, immutable parts with manifests, compaction."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.scalars import c, row_hash
from tidemark.operators.blocks import latest
from tidemark.session import pin, shared_folder

BATCH = "_batch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def upsert(df: DataFrame, path: str, keys: Sequence[str], parts: Sequence[str], order: Sequence[str]) -> None:
    """Merge rows into a partitioned Parquet tree, the newest row of a key staying.

    Only partitions the batch touches are read and rewritten. The merged rows are
    written to the checkpoint folder first, so a lost executor never sees half-replaced
    input.
    """
    spark, keys, parts = df.sparkSession, list(keys), list(parts)
    old = _stored(spark, path)
    both = df.withColumn(BATCH, F.lit(1))
    if old is not None:
        # Partition values come back typed by inference; keep the batch's types.
        old = old.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        touched = old.join(_touched(df.select(*parts).distinct()), parts, "left_semi")
        both = touched.withColumn(BATCH, F.lit(0)).unionByName(both)
    merged = pin(latest(both, [*parts, *[k for k in keys if k not in parts]], [BATCH, *order]).drop(BATCH))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _touched(parts: DataFrame, limit: int = 100_000) -> DataFrame:
    """The touched partitions: broadcast where they are few, else left to a shuffle join."""
    got = pin(parts)
    return F.broadcast(got) if got.count() <= limit else got


def upsert_documents(df: DataFrame, path: str, content: Sequence[str], parts: Sequence[str], order: Sequence[str]) -> None:
    """Upsert keyed by a digest of the content columns."""
    upsert(df.withColumn("doc_key", row_hash(*content)), path, ["doc_key"], parts, order)


def append_part(df: DataFrame, path: str, stream: str, clock: str, received: str) -> DataFrame:
    """Write one immutable part and return its manifest row: rows, span, schema digest, latency quantiles."""
    part = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{path}/data/stream={stream}/part={part}")
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    done = df.sparkSession.read.parquet(f"{path}/data/stream={stream}/part={part}")
    lag = (c(received) - c(clock)) / 1000.0
    row = done.agg(F.lit(stream).alias("stream"), F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.min(clock).alias("first"), F.max(clock).alias("last"),
                   F.sha2(F.lit(text), 256).alias("schema_digest"), F.percentile_approx(lag, 0.5).alias("latency_p50"), F.percentile_approx(lag, 0.99).alias("latency_p99"))
    row.write.mode("append").parquet(f"{path}/manifest")
    return row


def compact(spark: SparkSession, source: str, target: str, parts: Sequence[str], per_file: int = 5_000_000) -> None:
    """Rewrite many small files as few files per partition."""
    d = spark.read.parquet(source)
    d.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy(*parts).parquet(target)
