"""Time the headline queries: one JSON line with the seconds of each and their sum."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import REGISTRY  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = ["ohlcv_hourly", "aggressor_flow_bars", "asof_context", "master_frame", "event_study", "economic_labels", "triple_barrier", "event_path_labels", "prior_zscore", "ema_family",
            "other_symbol_density", "order_book_replay", "synchronised_venues", "options_daily_positioning", "overlapping_portfolio", "portfolio_grid", "episode_metrics",
            "placebo_side_flip", "global_spearman", "lexicon_sentiment"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["ohlcv_hourly"].run(spark, folder).write.format("noop").mode("overwrite").save()  # start the engine
    took = {}
    for name in HEADLINE:
        t = time.time()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
