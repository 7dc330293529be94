"""Single operators on small hand-made or random inputs against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import erfc, normal_cdf, normal_quantile, safe_div
from tidemark.operators import labels as L
from tidemark.operators import micro as M
from tidemark.operators import pit
from tidemark.operators import portfolio as P
from tidemark.operators import stats as S
from tidemark.operators import text as T
from tidemark.operators.blocks import sequence


def test_normal_law(spark):
    from statistics import NormalDist

    p = [0.001, 0.02, 0.3, 0.5, 0.77, 0.999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(normal_quantile("p")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], atol=1e-7)
    z = [-3.0, -0.5, 0.0, 1.2, 4.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf("z"), erfc("z")).collect()
    assert np.allclose([r[0] for r in rows], [NormalDist().cdf(x) for x in z], atol=2e-7)
    assert np.allclose([r[1] for r in rows], [math.erfc(x) for x in z], atol=2e-7)


def test_safe_division(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in d.select(safe_div("a", "b")).collect()] == pytest.approx([0.5, 1e12, 0.0])


def test_clocks(spark):
    d = pit.availability(spark.createDataFrame([(0,)], "t bigint"), event="t", kind="daily", live=False, bar_seconds=300).first()
    assert (d["market_available"], d["archive_published"]) == (300_000_000, 300_000_000 + 108_000_000_000)
    assert d["research_available"] - d["archive_published"] == 5_000_000 and d["execution_available"] - d["archive_published"] == 150_000
    bad = spark.createDataFrame([(5, 4), (5, 6)], "asof bigint, avail bigint")
    assert pit.late_rows(bad, "asof", "avail").count() == 1
    with pytest.raises(Exception, match="later than"):
        pit.assert_causal(bad, "asof", "avail").collect()


def test_plane_merge_rejects_repeated_keys(spark):
    base = spark.createDataFrame([(1, 1.0)], "k int, a double")
    with pytest.raises(Exception, match="repeats a key"):
        pit.merge_planes(base, [spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, b double")], ["k"]).collect()


def test_barrier_tie_and_tail(spark):
    rows = [(0, 10.0, 10.0, 10.0), (1, 12.0, 8.0, 10.0), (2, 10.5, 9.5, 10.0)]
    s = sequence(spark.createDataFrame([("s", *r) for r in rows], "k string, t bigint, high double, low double, close double"), ["k"], ["t"], ahead=2)
    s = s.add({"f": L.next_rows(s, 2, h="high", l="low", c="close")})
    up, down = F.col("close") + 1, F.col("close") - 1
    got = s.result("t", L.barrier(s, 2, F.col("f"), up, down).alias("a"), L.barrier(s, 2, F.col("f"), up, down, tie_up=False).alias("b"),
                   L.economic_side(F.col("f"), 2, F.col("close"), 0.1, 0.1, 0.0, 1).alias("e")).orderBy("t").collect()
    assert (got[0]["a"], got[0]["b"], got[1]["a"]) == (1, -1, None)
    assert got[0]["e"] == pytest.approx(math.log(0.9))


def water_fill(w, cap):
    w = np.asarray(w, float) / np.sum(w)
    if cap * len(w) < 1:
        return np.full(len(w), cap)
    fixed = np.zeros(len(w), bool)
    while (w > cap + 1e-12).any():
        fixed |= w > cap + 1e-12
        free = w[~fixed]
        w = np.where(fixed, cap, w / free.sum() * (1 - cap * fixed.sum()))
    return w


def test_capped_weights(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame([(g, f"n{i}", float(x)) for g in range(12) for i, x in enumerate(rng.pareto(1.0, rng.integers(2, 15)) + 0.01)], columns=["g", "n", "x"])
    got = P.capped_weights(spark.createDataFrame(p), group=["g"], name="n", raw="x", cap=0.25, out="w").toPandas().sort_values(["g", "n"]).reset_index(drop=True)
    p = p.sort_values(["g", "n"]).reset_index(drop=True)
    p["w"] = np.concatenate([water_fill(x.x, 0.25) for _, x in p.groupby("g")])
    assert np.allclose(got["w"], p["w"])


def test_book_replay_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(800):
        a = "snapshot" if rng.random() < 0.02 else "remove" if rng.random() < 0.15 else "update"
        rows.append(("s", int(i * 7 + rng.integers(0, 3)), i, bool(rng.random() < 0.5), float(rng.integers(0, 12)), int(rng.integers(0, 9)), a))
    p = pd.DataFrame(rows, columns=["k", "t", "i", "side", "p", "q", "a"])
    got = M.book_at_grid(spark.createDataFrame(p), keys=["k"], side="side", price="p", qty="q", action="a", clock="t", order=["t", "i"], step=100).toPandas()
    want, live = [], None
    for slot in range(int(p.t.max() // 100) + 1):
        up = p[p.t // 100 == slot]
        snap = up[up.a == "snapshot"].t.max()
        if not np.isnan(snap):
            up, live = up[up.t >= snap], {}
        if live is None:
            continue
        for r in up.itertuples():
            live[(r.side, r.p)] = 0 if r.a == "remove" else r.q
        want += [(slot, s, x, q) for (s, x), q in live.items() if q > 0]
    key = ["slot", "side", "p", "q"]
    assert sorted(map(tuple, got[key].itertuples(index=False))) == sorted(want)


def test_statistics(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0.1, 1, 400)
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i bigint, x double")
    nw = S.newey_west(d, ["k"], ["i"], "x", 3).first()["t"]
    e = x - x.mean()
    var = e @ e / 400 + sum(2 * (1 - k / 4) * (e[k:] @ e[:-k]) / 400 for k in (1, 2, 3))
    assert nw == pytest.approx(x.mean() / math.sqrt(var / 400))
    ess = S.effective_sample_size(d, ["k"], ["i"], "x", 5).first()["ess"]
    rho = 0.0
    for k in range(1, 6):
        r = np.corrcoef(x[k:], x[:-k])[0, 1]
        if r <= 0:
            break
        rho += r
    assert ess == pytest.approx(400 / (1 + 2 * rho))


def test_controls_for_the_placebo(spark):
    """A planted edge lies outside the null, noise inside."""
    rng = np.random.default_rng(6)
    for edge, inside in ((0.0, True), (1.0, False)):
        d = spark.createDataFrame([(i, float(v + edge)) for i, v in enumerate(rng.normal(0, 2, 300))], "i bigint, m double")
        null = S.sign_flip_null(d, [], ["i"], "m", 100, 1)
        p = S.null_summary(null, d.agg(F.avg("m").alias("m")), [], "m").first()["p"]
        assert (p > 0.05) == inside


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(31)], "node int")
    got = S.components(edges, nodes).toPandas()
    assert sorted(got["label"].unique()) == [0, 10, 20, 30]


def test_text(spark):
    html = "<html><script>x</script><p>A &amp; B</p><table><tr><td>1</td><td>2</td></tr></table>"
    assert spark.createDataFrame([(html,)], "h string").select(T.html_to_text("h")).first()[0] == "A & B\n1 2"
    tree = '[{"tag":"p","child":[{"node":"text","text":"a &lt; b"}]},{"tag":"p","child":[{"node":"text","text":"c"}]}]'
    assert spark.createDataFrame([(tree,)], "h string").select(T.tree_text("h")).first()[0] == "a < b\nc"
    text = "Trading\nDelisting of ABCUSDT on 2024-03-01 08:30 (UTC+8)\nABC will be available for trading at 2024-02-01"
    r = spark.createDataFrame([(text,)], "x string").select(T.announcement_times("x").alias("t")).select("t.*").first()
    assert str(r["delisting"]) == "2024-03-01 00:30:00" and str(r["trading_start"]) == "2024-02-01 00:00:00" and r["suspension"] is None
    d = spark.createDataFrame([("Bitcoin surges, no crash",), ("integration hacked",), ("",)], "x string")
    got = [x[0] for x in T.sentiment(d, "x", "s").select("s").collect()]
    assert got == pytest.approx([min(1.0, (2 + 0.7 * 3) / 2), max(-1.0, (1 - 3) / math.sqrt(2)), 0.0])
    assert d.select(T.tag_names("x")).first()[0] == ["BTCUSDT"]


def test_smoothers_carry_their_state_between_blocks(spark):
    """Missing stretches longer than the rows copied in front of a block, at its edges and inside."""
    import numpy as np

    from tidemark.operators import recurrence as K
    from tidemark.operators.blocks import sequence

    dice = np.random.default_rng(3)
    n, size = 26_000, 4_000
    x = 100 + dice.normal(0, 0.5, n).cumsum() * 0.01 + np.where(np.arange(n) > 9_000, 40.0, 0.0)
    gone = np.zeros(n, bool)
    for a, b in ((3_500, 8_200), (11_900, 12_100), (15_000, 15_001), (19_000, 25_000)):
        gone[a:b] = True
    gone |= dice.random(n) < 0.05
    rows = [(k, i, None if gone[i] or k == "none" else float(v), None if gone[i] else float(v) + 1, float(v) - 1) for k in ("a", "none") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t bigint, close double, high double, low double").repartition(3)
    hlc = ["high", "low", "close"]
    outs = {"ema": (K.ema(12), ["close"]), "tema": (K.tema(12), ["close"]), "trix": (K.trix(9), ["close"]), "rsi": (K.rsi(14), ["close"]), "kama": (K.kama(10), ["close"]), "atr": (K.atr(14), hlc), "adx": (K.directional(14, "adx"), hlc),
            "tsi": (K.tsi(10), ["close"]), "adjusted": (K.ewm_adjusted(20), ["close"]), "vol": (K.ewma_vol(60, 8760), ["close"]), "slow": (K.ema(400), ["close"])}
    run = lambda size: {(r.k, r.t): r for r in K.kernel_pass(sequence(df, ["k"], ["t"], back=60, size=size), outs).result("k", "t", *outs).collect()}
    whole, parts = run(250_000), run(size)
    assert len(whole) == len(parts) == 2 * n
    for name in outs:
        got, want = (np.array([np.nan if d[key][name] is None else d[key][name] for key in sorted(whole)]) for d in (parts, whole))
        assert np.array_equal(np.isnan(got), np.isnan(want)), name
        assert np.nanmax(np.abs(got - want)) < 1e-8, name


def test_deflated_sharpe_is_below_the_plain_one(spark, sf):
    from tidemark.plans import REGISTRY

    rows = REGISTRY["probabilistic_sharpe"].run(spark, sf).where("dsr is not null").collect()
    assert rows and all(r.dsr <= r.psr + 1e-6 for r in rows if r.benchmark > 0)
