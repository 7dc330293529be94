"""Forced-flow reversals: weak rows do not trigger, and liquidations rank where the feed is up."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.blocks import sequence
from tidemark.operators.events import cooldown, forced_flow
from tidemark.plans import REGISTRY


def rows():
    d = pd.DataFrame({"k": "a", "t": range(60), "flow": [float(i % 10 + 1) for i in range(60)], "doi": 0.0, "res": [0.01 * (-1) ** i for i in range(60)], "liq": [float(i % 10) for i in range(60)], "up": False})
    d.loc[40, ["flow", "doi", "res"]] = [9.5, -0.06, 0.015]  # rank 0.9, 1.5 sd: weak
    d.loc[42, ["flow", "doi", "res"]] = [-50.0, -0.08, 0.05]  # strong, two rows later
    d.loc[55, ["flow", "doi", "res", "liq", "up"]] = [1.0, -0.08, 0.2, 500.0, True]  # by liquidations only
    return d


def hits(spark, **kw):
    s = forced_flow(sequence(spark.createDataFrame(rows()), ["k"], ["t"], back=31), "flow", "doi", "res", 30, **kw)
    d = s.result("k", "t", "forced_flow").where(F.col("forced_flow")).select("k", "t")
    return [r.t for r in cooldown(d, ["k"], "t", 5).orderBy("t").collect()]


def test_weak_rows_do_not_hide_strong_ones(spark):
    assert hits(spark) == [42]
    assert hits(spark, rank=0.9, shock=1.0) == [40]


def test_liquidations_where_the_feed_is_up(spark):
    assert hits(spark, liquidations="liq", feed="up") == [42, 55]


def test_registered_thresholds():
    assert ">= 0.95" in REGISTRY["forced_flow_events"].sql and "2.5 * sd" in REGISTRY["forced_flow_events"].sql
