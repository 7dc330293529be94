"""Joins of two sides without any match."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402


@pytest.fixture
def doubled(spark, sf, tmp_path):
    """Every event twice, under another id: each left row has at least two partners or none."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.unionByName(e.withColumn("event_id", e.event_id + 1_000_000)).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    return str(tmp_path), con


def test_offsets_without_a_match_are_one_row(spark, doubled):
    folder, con = doubled
    assert con.execute(entry.oracle_sql()["match_offsets"]).fetchall() == [(0, None, None, None, None)]
    msg, _ = check.compare(spark, con, "match_offsets", folder)
    assert msg == "ok 1 rows", msg
