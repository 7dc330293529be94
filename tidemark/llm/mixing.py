"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size. Within a source the documents stand in
order of size; their expected copies are summed up, one random offset is added, and a document is taken once for each
whole number that the running sum crosses. As neighbours in that order are about equally long, the taken words come
within about one long document of the target.

Null, empty or blank texts have size 0 and are taken like others, with no words. A null source is a source of its own,
the last one. Repeated rows each count. A source without words has target 0. Tables without any word give targets 0.
Other columns of the documents pass through ``mix``; they may have any names but those that it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, stash
from tidemark.llm.prefix import running_sums

#: Weights of the sources in order of their code points, again and again.
WEIGHTS = (3, 1, 2)
#: What the mix holds in all, as a share of all sizes; and how often a source may be repeated.
SHARE, MOST = 1.5, 2
#: Copies are counted in whole parts of this size, so that sums are exact in any order.
UNIT = 1 << 24


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, weight and target, from one row (source, source_size) for each source.

    A source whose fair part is above ``most`` times its size stops there, and the rest is shared anew by weight.
    With the sources in order of most * size / weight, those that stop come first, so running sums tell the level
    at which the others are filled.
    """
    rank = running_sums(sizes.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1)), [], ["last", "source"], {"rank": "one"})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = rank.withColumn("weight", w.cast("long")).withColumn("top", F.col("source_size") * most).withColumn("full_at", F.col("top") / F.col("weight"))
    rows = stash(running_sums(rows, [], ["full_at", "last", "source"], {"filled": "top", "weights_before": "weight"}).drop("one", "rank"))
    whole = rows.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total, all_weights = share * (whole.s or 0), whole.w or 1
    level = (F.lit(total) - F.col("filled")) / (F.lit(all_weights) - F.col("weights_before"))
    # the first source in this order that is not full tells the level of all that are not
    first = rows.where(level <= F.col("full_at")).agg(F.min(F.struct("full_at", "last", "source", level.alias("level"))).alias("m")).first()
    water = first.m.level if first and first.m else 0.0
    return rows.select("source", "source_size", "weight", F.least(F.col("weight") * F.lit(water), F.col("top").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, digest, size, source_size, target and copies (how often the mix takes it) of every document."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("digest"))
    sized = stash(sized)
    sources = stash(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    named = sources.withColumnRenamed("source", "source_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_", "weight").withColumn("units", F.least(F.round(rate * UNIT), F.lit(float(most * UNIT))).cast("long"))
    rows = running_sums(rows, ["source"], ["size", "doc_id", "digest"], {"before": "units"})
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit(""))), F.lit(UNIT))
    crossed = F.floor((F.col("before") + F.col("units") + offset) / UNIT) - F.floor((F.col("before") + offset) / UNIT)
    return rows.withColumn("copies", crossed.cast("long")).drop("before", "units")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents' own rows, each as often as the mix takes it; rows alike in id, source and text share their copies."""
    keys = ["m_id_", "m_source_", "m_digest_"]
    taken = mix(docs, doc_id=doc_id, text=text, source=source, **options).groupBy(*[F.col(c).alias(k) for c, k in zip(("doc_id", "source", "digest"), keys, strict=True)]).agg(
        F.sum("copies").alias("m_copies_"), F.count("*").alias("m_rows_"))
    same = F.col(doc_id).eqNullSafe(F.col("m_id_")) & F.col(source).eqNullSafe(F.col("m_source_")) & (F.xxhash64(F.col(text)) == F.col("m_digest_"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("m_copies_"))
    share = F.floor(number * F.col("m_copies_") / F.col("m_rows_")) - F.floor((number - 1) * F.col("m_copies_") / F.col("m_rows_"))
    return docs.join(taken.where("m_copies_ > 0"), same).withColumn("m_times_", share.cast("int")).where("m_times_ > 0").withColumn("m_times_", F.explode(F.sequence(F.lit(1), F.col("m_times_")))).select(*[docs[c] for c in docs.columns])
