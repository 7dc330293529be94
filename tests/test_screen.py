"""Each day's screen comes from the flags of its own look-back, never from later days."""

from tidemark.plans import REGISTRY
from tidemark.plans.detectors import SCREEN_DAYS
from tidemark.plans.tables import panel


def test_screen_follows_each_days_look_back(spark, sf):
    flags = {(r.symbol, r.day) for r in REGISTRY["extreme_screen"].run(spark, sf).where("long_flag").collect()}
    paid = {(r.symbol, r.day): r.fund for r in panel(spark, sf).collect()}
    got = {(r.symbol, r.day): r.fraction for r in REGISTRY["screen_as_of"].run(spark, sf).collect()}
    on = {k for k in paid if paid[k] > 0 and any((k[0], d) in flags for d in range(k[1] - SCREEN_DAYS, k[1]))}
    assert on and {k for k in paid if paid[k] > 0} - on
    assert {k for k in paid if paid[k] > 0 and got[k] == 0} == on
