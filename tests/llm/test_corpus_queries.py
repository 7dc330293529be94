"""Registered queries: SQL twins, contracts and the pipeline, on the smallest tables."""

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import queries as llm
from tidemark.llm import tokens

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(llm.SQL[name]).df()
    got = llm.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = lambda df: sorted(df.astype(object).where(df.notna(), None).itertuples(index=False, name=None), key=str)
    assert key(got) == key(want)


def test_all_are_registered():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        kept.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in (before, *kept)]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] and len(ids[1]) >= 0.97 * len(ids[0])
    assert kept[1].count() == len(ids[2])
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    model = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) == len(texts)
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, len(model.encode(t or "", add_special_tokens=False))) for i, t in texts)
