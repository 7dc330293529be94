"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, mixing to target weights and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and hands it to the next stage. All stages but the last return the columns of ``documents``. A null or empty
text is dropped by the first stage; tables without rows pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, mixing, ngram_join, substrings
from tidemark.llm.common import stash, table
from tidemark.llm.queries import vocabulary

#: A document whose language is not told with at least this probability is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told."""
    return language.known_language(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of texts alike in 80 % of their five-word shingles."""
    return ngram_join.one_of_each(docs, words=5, threshold=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 50 words that an earlier document has; n_chars follows the text."""
    out = substrings.without_repeats(docs, window=50)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed_documents(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text, as counts and digests, of every document of the mix."""
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"), digests=True)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substring_dedup), ("mixing sources to target weights", source_mixing), ("BPE encoding and decoding", bpe_codec)]

#: The language model of the first stage cannot be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
