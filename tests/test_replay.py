"""Tables as streams: batches of several files; captures met in slots; held rows packed."""

import pickle
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import core as S
from tidemark.streaming import machines as M


def test_batches_hold_equally_many_files_in_order(spark, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 200)
    d = spark.range(8000).select("id", (F.col("id") * F.col("id")).alias("t"))  # far from even over the clock
    out = S.replay(d, "t", files=5)
    got = []
    out.writeStream.foreachBatch(lambda b, k: got.append((k, b.count(), b.agg(F.min("t"), F.max("t")).first(), b.select(F.input_file_name()).distinct().count()))).trigger(availableNow=True).start().awaitTermination()
    got.sort()
    assert sum(g[1] for g in got) == 8000 and len(got) >= 4
    assert {g[3] for g in got} == {5}
    assert all(a[2][1] < b[2][0] for a, b in zip(got, got[1:]))


def test_captures_meet_events_of_their_slots_only(spark):
    dice = random.Random(3)
    tr = [(i, dice.choice("xy"), s, s + dice.randint(-50, 400)) for i, s in enumerate(dice.choices(range(5000), k=60))]
    ev = [(i, dice.choice("xy"), dice.randrange(5500)) for i in range(400)]
    t = spark.createDataFrame(tr, "trigger bigint, k string, start bigint, finish bigint")
    e = spark.createDataFrame(ev, "event bigint, k string, at bigint")
    d = M.captured(t, e, "k", "at", 240, "1 second")
    want = sorted((a[0], b[0]) for a in tr for b in ev if a[1] == b[1] and a[2] <= b[2] <= min(a[3], a[2] + 240))
    assert sorted(tuple(r) for r in d.select("trigger", "event").collect()) == want
    assert d.columns == ["trigger", "start", "finish", "event", "k", "at"]
    assert "slot_" in d._jdf.queryExecution().optimizedPlan().toString()


def bridge_rows(n):
    rows = [(t, t, "delta", 10 * t, 10 * t + 9, 10 * t - 1) for t in range(n)]
    return rows + [(t, n + t, "snapshot", 0, 10 * t, M.NO_LONG) for t in range(5, n, 10)]


class States:
    """Stand-ins for the states of one key."""

    def __init__(self):
        self.states, self.timers, self.data = {}, [], None

    def getListState(self, name, *_):
        return self.states.setdefault(name, States())

    getValueState = getMapState = getListState
    exists = lambda self: self.data is not None
    get = lambda self: self.data if self.data is not None else []
    getCurrentWatermarkInMs = lambda self: 10

    def put(self, x):
        self.data = x

    update = put

    def clear(self):
        self.data = None

    def appendValue(self, x):
        self.data = [*self.get(), x]

    def registerTimer(self, at):
        self.timers.append(at)


def test_rows_are_held_as_packed_frames_and_outcomes_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(M, "FRAME_ROWS", 50)
    machine, handle = M.Bridge("k", 40), States()
    machine.init(handle)
    rows = bridge_rows(120)
    random.Random(1).shuffle(rows)
    frame = pd.DataFrame(rows, columns=machine.names)
    list(machine.handleInputRows(("a",), iter([frame.iloc[:70], frame.iloc[70:]]), handle))
    held = handle.states["pending"].get()
    assert len(held) == 2 and all(isinstance(pickle.loads(r[0])["recv"], np.ndarray) for r in held) and handle.timers == [11]
    parts = list(machine.handleExpiredTimer(("a",), handle, None))
    assert len(parts) > 5 and all(len(p) <= 50 + 120 for p in parts)
    whole = M.Bridge("k", 40)
    whole.init(States())
    want, *_ = whole.advance(sorted(rows), 10_000)
    assert [(*r[1:-1], M.OUTCOMES[r[-1]]) for p in parts for r in p.itertuples(index=False, name=None)] == want
    assert handle.states["pending"].data is None
