"""Captures as state kept by key against one loop a session, over batches, restarts and timers."""

import random

import pytest
from sluicework.streaming import capture

EVENT = "session long, seq long, kind string, x double, y double, a double, b double"


def events(seed, sessions=6, each=60):
    r = random.Random(seed)
    kinds = [k for k in capture.KINDS if k != "discard"] + ["point"] * 5 + ["advance", "axis", "undo", "redo", "unknown"]
    out = []
    for s in range(sessions):
        head = [("start" if s % 2 else "free",)] + [(k,) for _ in range(3) for k in ("axis", "advance")]
        for n, k in enumerate([*head, *((r.choice(kinds if r.random() < 0.97 else ["discard"]),) for _ in range(each))]):
            out.append((s, n, k[0], float(r.randint(0, 3)), float(r.randint(0, 3)), r.random(), r.random()))
    return out


def streamed(spark, tmp_path, batches, idle_ms=None):
    for batch in batches:
        spark.createDataFrame(batch, EVENT).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        capture.caught_up(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "run"), idle_ms)
    return {r.session: r for r in capture.latest(spark, str(tmp_path / "run")).collect()}


def test_state_over_batches_is_that_of_one_loop(spark, tmp_path):
    rows = events(1)
    got = streamed(spark, tmp_path, [[e for e in rows if e[1] % 67 < 20], [e for e in rows if 20 <= e[1] % 67 < 40], [e for e in rows if e[1] % 67 >= 40]])
    for s in {e[0] for e in rows}:
        flow = capture.Flow()
        for e in (e for e in rows if e[0] == s):
            flow.take(*e[2:])
        r = got[s]
        assert (r.events, r.stage, r.axes, r.points, r.undone, r.locked, r.errors) == (67, flow.stage, len(flow.axes), len(flow.points), len(flow.undone), len(flow.locked), ",".join(flow.errors))
        assert (r.last_x, r.last_y) == (flow.points[-1] if flow.points else (None, None)) and not r.expired
    assert any(r.locked for r in got.values()) and any(r.errors for r in got.values())


def test_a_run_without_new_events_changes_nothing(spark, tmp_path):
    batch = [(1, 0, "duplicate", None, None, None, None), (1, 1, "point", 1.0, 2.0, None, None), (2, 0, "nothing", None, None, None, None)]
    first = streamed(spark, tmp_path, [batch])
    capture.caught_up(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "run"))
    assert {r.session: r for r in capture.latest(spark, str(tmp_path / "run")).collect()} == first
    assert (first[1].points, first[1].last_x, first[2].stage, first[2].events) == (1, 1.0, 0, 1)


def test_idle_sessions_are_given_up(spark, tmp_path):
    start = [(1, 0, "duplicate", None, None, None, None), (1, 1, "point", 1.0, 2.0, None, None)]
    got = streamed(spark, tmp_path, [start, [(2, 0, "start", None, None, None, None)]], idle_ms=1)
    assert got[1].expired and got[1].points == 1
    again = streamed(spark, tmp_path, [[(1, 2, "point", 5.0, 5.0, None, None)]], idle_ms=1)
    told = spark.read.parquet(str(tmp_path / "run" / "told")).where("session = 1 and events = 1").collect()
    assert [(t.stage, t.points) for t in told if not t.expired] == [(0, 0)] and again[1].expired  # forgotten: a point alone starts nothing


@pytest.mark.parametrize("kind", capture.KINDS)
def test_every_kind_has_an_effect_in_some_phase(kind):
    assert any(k == kind for _, k in capture.EFFECTS) and all(hasattr(capture._Effects, e) for e in capture.EFFECTS.values())


def test_the_store_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with capture.with_lists(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_a_new_session_asks_for_no_lists():
    import pandas as pd

    from sluicework.streaming import capture

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Held:
        value, asked = None, 0

        def exists(self):
            self.asked += 1
            return bool(self.value)

        def get(self):
            return self.value

        def put(self, v):
            self.value = v

        def clear(self):
            self.value = None

    p = capture.KeptCapture()
    p.flow, p.lists = Value(), {n: Held() for n in ("axes", "points", "undone")}
    none = float("nan")
    rows = pd.DataFrame([(2, "point", 5.0, 0.0, none, none), (1, "duplicate", none, none, none, none)], columns=["seq", "kind", "x", "y", "a", "b"])
    told = next(iter(p.handleInputRows((7,), iter([rows.iloc[:1], rows.iloc[1:]]), None)))
    assert (told.session[0], told.events[0], told.points[0], told.last_x[0]) == (7, 2, 1, 5.0) and told.last_y.dtype == "float64"
    assert not any(h.asked for h in p.lists.values()) and p.lists["points"].value == [(5.0, 0.0)]
