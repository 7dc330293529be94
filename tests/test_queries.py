"""Registered queries against their SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SAMPLE = ["event_study", "asof_context", "asof_forward", "mutual_match", "other_symbol_density", "aggressor_flow_bars", "ema_family", "hysteresis_state", "triple_barrier", "economic_labels",
          "event_path_labels", "centred_rank", "overlapping_portfolio", "episode_metrics", "placebo_time_shuffle", "bootstrap_lower_bound", "global_spearman", "bh_qvalues", "oi_cascade",
          "pit_audit", "html_to_text", "lexicon_sentiment", "series_coverage", "order_book_replay", "wallet_flow", "partitioned_upsert", "stream_sessions", "stream_suppressed_triggers", "volume_family",
          "cscv_overfitting", "cluster_robust", "forced_flow_reversal", "spearman_matrix", "ridge_walk_forward", "har_components", "ewma_volatility", "volume_accumulators", "next_price_move", "stream_event_clusters",
          "screen_applied", "capacity_policy", "sequence_features", "state_tape", "stream_state_tape", "stream_snapshot_alignment", "stream_capture_windows", "stream_book_metrics", "stream_listing_changes", "manifest_verification",
          "archived_klines", "document_upsert", "live_validation", "rank_duplicates", "har_regression"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, sf, name):
    msg, _ = check.compare(spark, con, name, sf)
    assert msg.startswith("ok"), msg


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 250
    df = entry.entry(spark)
    assert df.count() > 0 and "t_stat" in df.columns
