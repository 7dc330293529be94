"""Results that grow with a product are written as their parts: runs over blocks, captures and events of a slot."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_replay import States, bridge_rows
from tidemark.plans import REGISTRY
from tidemark.streaming import core as S
from tidemark.streaming import machines as M


def packed(rows, keep, marks):
    """Packed rows of one key whose rows come up to each of the marks."""
    machine, handle, out = M.PackedBridge("k", keep), States(), []
    machine.init(handle)
    held = pd.DataFrame({n: pd.Series([], dtype=object if n == "kind" else "int64") for n in machine.names})
    rows = pd.DataFrame(rows, columns=machine.names).sort_values(machine.names, ignore_index=True)
    for m in marks:
        held, rows = pd.concat([held, rows[rows["recv"] <= m]], ignore_index=True), rows[rows["recv"] > m]
        made, rest, _ = machine.frames(("a",), held, m)
        held = held.iloc[len(held) - rest:]
        out += [r for f in made for r in f.to_dict("records")]
    return out


def unpacked(out):
    rows = []
    for r in out:
        for at, number, lo, hi, code in zip(*[r[n] for n in M.RUN], strict=True):
            rows += [(at, number, recv, last, M.OUTCOMES[code]) for recv, last in zip(r["recv_us"][lo:hi], r["last_id"][lo:hi], strict=True)]
    return rows


def depth(seed):
    """Ids that mostly rise; some deltas are lost, out of place or do not name their predecessor."""
    dice, rows = random.Random(seed), []
    for t in range(150):
        i = t + (dice.randint(-4, 4) if seed % 2 and dice.random() < 0.1 else 0)
        if dice.random() < 0.1:
            rows.append((t, t, "snapshot", 0, 10 * t + dice.randint(-80, 30), M.NO_LONG))
        elif dice.random() > 0.03:
            rows.append((t, t, "delta", 10 * i, 10 * i + 9, 10 * i - 1 if dice.random() < 0.8 else M.NO_LONG))
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_packed_outcomes_equal_those_row_by_row(seed, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 16)
    monkeypatch.setattr(M, "BLOCK_RUNS", 5)
    rows = depth(seed)
    whole = M.Bridge("k", 40)
    whole.init(States())
    want, *_ = whole.advance(sorted(rows), 10_000)
    for marks in ([10_000], [*sorted(random.Random(seed).sample(range(150), 6)), 10_000]):
        out = packed(rows, 40, marks)
        assert sorted(unpacked(out)) == sorted(want)
        assert all(len(r["recv_us"]) <= 16 and len(r["lo"]) <= 5 and r["n_rows"] == sum(r["hi"] - r["lo"]) for r in out)


def test_alignment_writes_deltas_and_runs_not_their_product():
    size = {}
    for n in (2000, 8000):  # an epoch for each ten deltas, each with the deltas of a quarter of the time
        out = packed(bridge_rows(n), n // 4, [10 * n])
        size[n] = sum(len(r["recv_us"]) + len(r["lo"]) for r in out), sum(r["n_rows"] for r in out)
    assert size[8000][1] > 15 * size[2000][1] and size[8000][0] < 5 * size[2000][0]


def test_packed_runs_become_rows(spark):
    out = packed(depth(3), 40, [10_000])
    d = spark.createDataFrame([(r["k"], *[x.tolist() if hasattr(x, "tolist") else x for x in list(r.values())[1:]]) for r in out], M.PackedBridge("k", 40).out)
    got = M.bridge_rows(S.spread(d, "n_rows"), "k")
    assert sorted(tuple(r) for r in got.select("epoch_us", "snapshot_id", "recv_us", "last_id", "outcome").collect()) == sorted(unpacked(out))


def test_slots_hold_each_row_once_and_no_missing_key_meets(spark):
    t = spark.range(400).select(F.col("id").alias("trigger"), F.when(F.col("id") % 20 > 0, "x").alias("k"), F.lit(0).cast("bigint").alias("start"), F.lit(19).cast("bigint").alias("finish"))
    e = spark.range(600).select(F.col("id").alias("event"), F.when(F.col("id") % 30 > 0, "x").alias("k"), (F.col("id") % 25).alias("at"))
    slots = M.capture_slots(t, e, "k", "at", 240, "1 second")
    held = slots.select(F.sum(F.size("captures_")), F.sum(F.size("events_"))).first()
    assert tuple(held) == (380, 464)
    pairs = M.captured_rows(slots, "k", "at", e.columns)
    assert pairs.count() == pairs.distinct().count() == 380 * 464 and pairs.where("k is null or at > 19").count() == 0


def test_values_are_rounded_before_they_meet(spark, sf):
    q = REGISTRY["stream_capture_windows"].run(spark, sf)
    assert "round(" not in q._jdf.queryExecution().optimizedPlan().toString()
