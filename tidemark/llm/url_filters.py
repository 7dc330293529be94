"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

A url is a null, empty or odd text as well: without ``://`` its host and path are empty and no rule fits. Repeated
pages are judged one by one. Rules with a null host or path are left out; equal rules count once; of equally long
rules, block comes first. Columns of the pages other than ``url`` and ``key`` play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join compares first.
PREFIX = 8
#: Copies of each rule, so that expressions of a very common host are dealt over as many tasks.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(authority, UPPER, LOWER), path


def host_suffixes(host) -> F.Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def digest(host, path) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of every page.

    rules: host, path (the start of a fitting url's path) and verdict. The longest fitting rule (host and path
    together) decides; pages that none fits get ``default``.
    """
    rules = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("full", digest(F.col("r_host"), F.col("r_path")))
        .withColumn("short", F.substring("full", 1, PREFIX))
    )
    # the lengths at which a path is cut are those of the rules' paths: distinct small numbers, however many the rules
    cuts = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    host, path = split_url(F.col("url_"))
    found = pages.select(F.col(key).alias("key_"), F.col(url).alias("url_")).withColumn("host", host).withColumn("path", path).drop("url_")
    probes = (
        found.where("host <> ''")
        .withColumn("h", F.explode(host_suffixes(F.col("host"))))
        .withColumn("n", F.explode(F.filter(F.array(*map(F.lit, cuts)).cast("array<int>"), lambda n: n <= F.length("path"))))
        .withColumn("full", digest(F.col("h"), F.expr("substring(path, 1, n)")))
        .withColumn("short", F.substring("full", 1, PREFIX))
        .withColumn("salt", F.pmod(F.xxhash64("key_", "path"), F.lit(SALTS)).cast("int"))
        .select("key_", "host", "path", "full", "short", "salt")
    )
    copies = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("full", "r_full")
    hits = (
        probes.join(copies, ["short", "salt"])
        .where("full = r_full")
        .groupBy(F.col("key_").alias("f_key"), F.col("host").alias("f_host"), F.col("path").alias("f_path"))
        .agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    )
    same = F.col("key_").eqNullSafe(F.col("f_key")) & (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path"))
    return found.join(hits, same, "left").select(
        F.col("key_").alias(key), "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
