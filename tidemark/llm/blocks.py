"""Vectors in blocks: rows packed for matrix work, and each block of queries paired with each block of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def usable(vectors: DataFrame, vec_id: str, embedding: str, zero: bool = True) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part: not null, finite, with components.

    Rows that share an id count as one; the smallest vector is kept. ``zero``: whether all-zero vectors take part.
    """
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0.0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, per_block: int, pack: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """One row for each block of about ``per_block`` vectors of one length: block (a number), size and what ``pack`` makes.

    Rows are dealt in turn, so no key can fill a block, and blocks are cut within tasks.
    """
    n = rows.count()
    dealt = rows.repartition(max(1, ceil(n / per_block)))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(dim: int):
            ids, vs = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")
            made = pack(ids[order], vs[order])
            return pa.RecordBatch.from_pylist([{"first_id": int(ids.min()), "size": len(ids), "dim": dim, **made}], schema=arrow)

        arrow = pa.schema([("first_id", pa.int64()), ("size", pa.int64()), ("dim", pa.int64()), *[(f.split()[0], pa.binary()) for f in schema.split(",")]])
        for batch in batches:
            v = batch.column("v")
            ids, size = batch.column("vec_id").to_numpy(), v.value_lengths().to_numpy()
            flat, at = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                held.setdefault(int(dim), []).append((ids[mine], flat[(at[mine][:, None] + np.arange(dim)[None, :])]))
                if sum(len(x[0]) for x in held[int(dim)]) >= 2 * per_block:
                    yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return dealt.mapInArrow(cut, f"first_id bigint, size bigint, dim bigint, {schema}")


def cells(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Every block of queries beside every index block of the same vector length: an equi-join on the pair's numbers."""
    nq, ni = queries.count(), index.count()
    cell = lambda df, n: df.withColumn("own", F.pmod(F.xxhash64("first_id", "dim"), F.lit(max(n, 1))).cast("int"))
    q = cell(queries, nq).select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(max(ni, 1) - 1))).alias("b"))
    i = cell(index, ni).select("*", F.col("own").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(nq, 1) - 1))).alias("a"))
    return q.hint("merge").join(i.drop("own"), ["a", "b"]).where("q_dim = dim").drop("a", "b", "q_dim")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k first rows (query_id, vec_id, score) of each query: highest score, then smallest vec_id. Adds rank."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
