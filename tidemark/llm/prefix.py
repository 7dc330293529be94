"""Exclusive running sums of whole numbers over a table of any size, without one task that sees all of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stash, tasks


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each name: column of ``sums`` (whole numbers), the sum of the rows before this one in its group.

    Rows are dealt by ranges of (group, order) and written; each range then needs only the totals of the ranges
    before it, one row for each range and group. A hot group spans as many ranges as it fills. Ties in ``order`` fall
    in any order; null sorts first.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(tasks(spark), *group, *order).sortWithinPartitions(*group, *order)
    rows = stash(ranged.withColumn("part_", F.spark_partition_id()))
    keys = [*group, "part_"]
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"total_{name}") for name, c in sums.items()])
    before = W.partitionBy(*group).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges at most
    totals = totals.select(*[F.col(k).alias(f"t_{k}") for k in keys], *[F.coalesce(F.sum(f"total_{name}").over(before), F.lit(0)).alias(f"before_{name}") for name in sums])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumns({f"within_{name}": F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).join(totals, same)
    return out.select(*df.columns, *[(F.col(f"within_{name}") + F.col(f"before_{name}")).alias(name) for name in sums])
