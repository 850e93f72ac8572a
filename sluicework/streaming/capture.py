"""Capture sessions: points added, undone and redone, in order; as a batch fold, as a stateful stream, and from calibration to locked curves as state kept by key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.shipping import ship

#: What an event means; others do nothing.
ADD, UNDO, REDO, DISCARD, LOCK = "click", "view", "purchase", "error", "signup"


def _step(s: Column, e: Column) -> Column:
    """One event on (done, undone, locked): a new point clears what was undone; a discard clears all; a lock ends the capture."""
    kind, n, m = e["kind"], F.size(s["done"]), F.size(s["undone"])
    none = F.array().cast("array<bigint>")
    done = F.when(kind == ADD, F.concat(s["done"], F.array(e["seq"]))).when((kind == UNDO) & (n > 0), F.slice(s["done"], F.lit(1), F.greatest(n - 1, F.lit(0)))).when((kind == REDO) & (m > 0), F.concat(s["done"], F.slice(s["undone"], -1, 1))).when(kind == DISCARD, none).otherwise(s["done"])
    undone = F.when((kind == ADD) | (kind == DISCARD), none).when((kind == UNDO) & (n > 0), F.concat(s["undone"], F.slice(s["done"], -1, 1))).when((kind == REDO) & (m > 0), F.slice(s["undone"], F.lit(1), F.greatest(m - 1, F.lit(0)))).otherwise(s["undone"])
    return F.when(s["locked"], s).otherwise(F.struct(done.alias("done"), undone.alias("undone"), (kind == LOCK).alias("locked")))


def fold(events: DataFrame) -> DataFrame:
    """(session, points, undone, locked, last). events: session, seq, at, kind; a session's events fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "seq", "kind")))
    none = F.array().cast("array<bigint>")
    state = F.aggregate("events", F.struct(none.alias("done"), none.alias("undone"), F.lit(False).alias("locked")), _step)
    rows = events.select("session", "at", F.col("seq").cast("bigint").alias("seq"), "kind").groupBy("session").agg(ordered.alias("events")).select("session", state.alias("s"))
    return rows.select("session", F.size("s.done").alias("points"), F.size("s.undone").alias("undone"), "s.locked", F.coalesce(F.try_element_at("s.done", F.lit(-1)), F.lit(-1)).alias("last"))


def apply(done: list[int], undone: list[int], locked: bool, kind: str, seq: int) -> tuple[list[int], list[int], bool]:
    if locked:
        return done, undone, locked
    if kind == ADD:
        return [*done, seq], [], False
    if kind == UNDO and done:
        return done[:-1], [*undone, done[-1]], False
    if kind == REDO and undone:
        return [*done, undone[-1]], undone[:-1], False
    if kind == DISCARD:
        return [], [], False
    return done, undone, kind == LOCK


def stream(events: DataFrame) -> DataFrame:
    """The fold over a stream, a session's state kept between batches: (session, points, undone, locked, last) whenever it changes."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, undone, locked = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], False)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        for kind, seq in zip(rows["kind"], rows["seq"], strict=True):
            done, undone, locked = apply(done, undone, locked, kind, int(seq))
        state.update((done, undone, locked))
        yield pd.DataFrame({"session": [key[0]], "points": [len(done)], "undone": [len(undone)], "locked": [locked], "last": [done[-1] if done else -1]})

    return events.groupBy("session").applyInPandasWithState(update, "session long, points int, undone int, locked boolean, last long", "done array<long>, undone array<long>, locked boolean", "update", GroupStateTimeout.NoTimeout)


# --- calibration and capture ------------------------------------------------------------------------

#: What a session's events do. An axis event sets x, y and one or two values; others use x and y or nothing.
KINDS = ("start", "duplicate", "free", "axis", "advance", "point", "undo", "redo", "discard")


@dataclass
class Flow:
    """A capture from its start to the locked curve: stages 1 to 3 calibrate the axes by a point each, stage 4 takes points; a duplicate begins there.

    In stage 2 the point keeps the first one's Y value and in stage 3 its X value, unless the session is free.
    """

    stage: int = 0
    free: bool = False
    pending: tuple | None = None
    axes: list[tuple] = field(default_factory=list)
    points: list[tuple] = field(default_factory=list)
    undone: list[tuple] = field(default_factory=list)
    locked: list[tuple] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def take(self, kind: str, x: float | None = None, y: float | None = None, a: float | None = None, b: float | None = None) -> None:
        if kind in ("start", "duplicate", "free"):
            axes = self.axes if kind == "duplicate" else []
            self.stage, self.free, self.pending = 4 if kind == "duplicate" else 1, kind == "free", None
            self.axes, self.points, self.undone = list(axes), [], []
        elif kind == "discard":
            self.stage, self.pending, self.points, self.undone = 0, None, [], []
        elif kind == "axis" and 1 <= self.stage <= 3:
            first = self.axes[0] if self.axes else None
            values = (a, b) if self.free or self.stage == 1 or first is None else (a, first[3]) if self.stage == 2 else (first[2], a)
            self.pending = (x, y, *values)
        elif kind == "advance" and 1 <= self.stage <= 3:
            self._calibrate()
        elif kind == "advance" and self.stage == 4:
            self.locked.append((list(self.axes), list(self.points)))
            self.stage, self.points, self.undone = 0, [], []
        elif kind == "point" and self.stage == 4:
            self.points.append((x, y))
            self.undone.clear()
        elif kind == "undo" and self.stage == 4 and self.points:
            self.undone.append(self.points.pop())
        elif kind == "redo" and self.stage == 4 and self.undone:
            self.points.append(self.undone.pop())

    def _calibrate(self) -> None:
        if self.pending is None:
            self.errors.append("no point")
            return
        axes = [*self.axes, self.pending]
        if len(axes) == 3:
            (p0, q0, *_), (p1, q1, *_), (p2, q2, *_) = axes
            if abs((p1 - p0) * (q2 - q0) - (p2 - p0) * (q1 - q0)) < 1e-12:
                self.errors.append("degenerate")
                return
        self.axes, self.pending = axes, None
        self.stage += 1


def sessions(events: DataFrame) -> DataFrame:
    """(session, stage, axes, points, locked, errors) after each session's events in order: how many of each there are. events: session, seq, kind, x, y, a, b; a session's events fit a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        flow = Flow()
        for r in rows.sort_values("seq").itertuples():
            flow.take(r.kind, r.x, r.y, r.a, r.b)
        return pd.DataFrame({"session": [rows["session"].iloc[0]], "stage": [flow.stage], "axes": [len(flow.axes)], "points": [len(flow.points)], "locked": [len(flow.locked)], "errors": [",".join(flow.errors)]})

    return events.groupBy("session").applyInPandas(run, "session long, stage int, axes int, points int, locked int, errors string")


# --- captures kept by key ------------------------------------------------------------------------------

#: What an event does in a phase of a capture: idle, calibrating an axis (stages 1 to 3) or taking points; `any` holds in all. Others do nothing.
EFFECTS = {
    ("any", "start"): "begin", ("any", "free"): "begin_free", ("any", "duplicate"): "begin_again", ("any", "discard"): "drop",
    ("calibrating", "axis"): "place", ("calibrating", "advance"): "calibrate", ("capturing", "advance"): "lock",
    ("capturing", "point"): "add", ("capturing", "undo"): "undo", ("capturing", "redo"): "redo",
}
_POINT, _AXIS = "x double, y double", "x double, y double, a double, b double"
_FLOW = "stage int, free boolean, placed boolean, x double, y double, a double, b double, locked int, errors string, events long, seen long"
KEPT = "session long, events long, stage int, axes int, points int, undone int, locked int, errors string, last_x double, last_y double, expired boolean"


def phase(stage: int) -> str:
    return "calibrating" if 1 <= stage <= 3 else "capturing" if stage == 4 else "idle"


class KeptCapture(StatefulProcessor):
    """A session's capture as state of its own: a value for the stage and what is placed, lists for axes, points and what was undone.

    A batch reads what it needs of a session and writes back the lists that it has changed. A session without events for `idle_ms` is given up by a timer: it is
    told once more, as expired, and forgotten. Events of a session come in order from batch to batch, and in any order within one.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", _FLOW)
        self.lists = {"axes": handle.getListState("axes", _AXIS), "points": handle.getListState("points", _POINT), "undone": handle.getListState("undone", _POINT)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = _names(_FLOW)
        known = self.flow.exists()  # a new session has no lists to ask for: each question is a round trip
        flow = dict(zip(names, self.flow.get(), strict=True)) if known else dict(zip(names, (0, False, False, None, None, None, None, 0, "", 0, 0), strict=True))
        held = {n: [tuple(t) for t in s.get()] if known and s.exists() else [] for n, s in self.lists.items()}
        before = {n: list(v) for n, v in held.items()}
        events = [e for f in rows for e in zip(*(f[c].tolist() for c in ("seq", "kind", "x", "y", "a", "b")), strict=True)]
        for _, kind, *values in sorted(events, key=lambda e: e[0]):
            flow["events"] += 1
            effect = EFFECTS.get(("any", kind)) or EFFECTS.get((phase(flow["stage"]), kind))
            if effect:
                getattr(_Effects, effect)(flow, held, *(None if v is None or v != v else v for v in values))
        if self.idle_ms is not None:
            flow["seen"] = timerValues.getCurrentProcessingTimeInMs()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(flow["seen"] + self.idle_ms)
        self.flow.update(tuple(flow[n] for n in names))
        for n, state in self.lists.items():
            if held[n] != before[n]:
                state.put(held[n]) if held[n] else state.clear()
        yield self._told(key, flow, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.flow.exists():
            flow = dict(zip(_names(_FLOW), self.flow.get(), strict=True))
            yield self._told(key, flow, {n: [tuple(t) for t in s.get()] if s.exists() else [] for n, s in self.lists.items()}, True)
            self.flow.clear()
            for state in self.lists.values():
                state.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _told(key, flow: dict, held: dict, expired: bool) -> pd.DataFrame:
        last = held["points"][-1] if held["points"] else (None, None)
        values = (key[0], flow["events"], flow["stage"], len(held["axes"]), len(held["points"]), len(held["undone"]), flow["locked"], flow["errors"], *last, expired)
        floats = ("last_x", "last_y")
        return pd.DataFrame({n: np.array([v], np.float64) if n in floats else [v] for n, v in zip(_names(KEPT), values, strict=True)})


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class _Effects:
    """What EFFECTS names, on a session's value and lists."""

    @staticmethod
    def _begin(flow: dict, held: dict, stage: int, free: bool) -> None:
        flow.update(stage=stage, free=free, placed=False)
        held["points"], held["undone"] = [], []

    @staticmethod
    def begin(flow: dict, held: dict, *_) -> None:
        _Effects._begin(flow, held, 1, False)
        held["axes"] = []

    @staticmethod
    def begin_free(flow: dict, held: dict, *_) -> None:
        _Effects._begin(flow, held, 1, True)
        held["axes"] = []

    @staticmethod
    def begin_again(flow: dict, held: dict, *_) -> None:
        _Effects._begin(flow, held, 4, False)

    @staticmethod
    def drop(flow: dict, held: dict, *_) -> None:
        _Effects._begin(flow, held, 0, flow["free"])

    @staticmethod
    def place(flow: dict, held: dict, x, y, a, b) -> None:
        """The second axis point has the first one's Y value, the third its X value, unless the session is free."""
        first = held["axes"][0] if held["axes"] and not flow["free"] else None
        if first is not None and flow["stage"] > 1:
            a, b = (a, first[3]) if flow["stage"] == 2 else (first[2], a)
        flow.update(placed=True, x=x, y=y, a=a, b=b)

    @staticmethod
    def calibrate(flow: dict, held: dict, *_) -> None:
        """The placed point becomes an axis point; three in a line give no calibration."""
        wrong = "" if flow["placed"] else "no point"
        axes = [*held["axes"], tuple(flow[c] for c in "xyab")]
        if not wrong and len(axes) == 3:
            u, v = ((p[0] - axes[0][0], p[1] - axes[0][1]) for p in axes[1:])
            wrong = "degenerate" if abs(u[0] * v[1] - v[0] * u[1]) < 1e-12 else ""
        if wrong:
            flow["errors"] = ",".join(filter(None, (flow["errors"], wrong)))
            return
        held["axes"] = axes
        flow.update(placed=False, stage=flow["stage"] + 1)

    @staticmethod
    def lock(flow: dict, held: dict, *_) -> None:
        flow.update(stage=0, locked=flow["locked"] + 1)
        held["points"], held["undone"] = [], []

    @staticmethod
    def add(flow: dict, held: dict, x, y, *_) -> None:
        held["points"], held["undone"] = [*held["points"], (x, y)], []

    @staticmethod
    def undo(flow: dict, held: dict, *_) -> None:
        if held["points"]:
            held["points"], held["undone"] = held["points"][:-1], [*held["undone"], held["points"][-1]]

    @staticmethod
    def redo(flow: dict, held: dict, *_) -> None:
        if held["undone"]:
            held["points"], held["undone"] = [*held["points"], held["undone"][-1]], held["undone"][:-1]


def kept(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(KEPT) of each session that a batch brings events of, and of each that is given up. events: a stream of session, seq, kind, x, y, a, b.

    The state store must be one that holds lists and timers (`with_lists`).
    """
    ship(events.sparkSession)
    rows = events.select(F.col("session").cast("long").alias("session"), F.col("seq").cast("long").alias("seq"), "kind", *(F.col(c).cast("double").alias(c) for c in "xyab"))
    return rows.groupBy("session").transformWithStateInPandas(KeptCapture(idle_ms), KEPT, "Append", "None" if idle_ms is None else "ProcessingTime")


#: Settings of streams that keep lists and timers. Without new events no batch is run for timers alone, which would go on for ever where a stream is to end.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def with_lists(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state where lists and timers can be held; the session's settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def caught_up(source: DataFrame, folder: str, idle_ms: int | None = None) -> None:
    """Takes all events that are there and were not taken before into the folder's state, adding what sessions have become to its table; a run that failed is done again from its checkpoint."""
    with with_lists(source.sparkSession):
        writer = kept(source, idle_ms).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.start(f"{folder}/told").awaitTermination()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each session as it was told last, by how many events it has had."""
    told = spark.read.schema(KEPT).parquet(f"{folder}/told")
    rest = [c for c in _names(KEPT) if c != "session"]
    return told.groupBy("session").agg(F.max(F.struct("events", "expired", *(c for c in rest if c not in ("events", "expired")))).alias("s")).select("session", *(f"s.{c}" for c in rest))
