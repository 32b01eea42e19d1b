"""Rules per device or session over events in order of time: interlock, stability, quality, capture, motion stretches.

A rule is a step from (what is held, one event) to (what is held, rows to emit). `ordered` applies it to a stream: events wait
in the state of their key, sorted, until the watermark says that nothing earlier can come; a timer at the
first waiting event wakes the key. So the rows do not depend on how the input is cut into files or micro-batches, as
long as events are late by `delay` at most; later ones are dropped by Spark. `replay` runs a finished stream to its
end and then takes the events that still wait from the state.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.session import scratch_path
from framelake.streaming.common import manifest_sink

READY, MOVING, SETTLING = "READY", "MOVING", "SETTLING"
# Status of the interlock and the reason it reports.
REASONS = {"OK": "ready", "BUSY_MOVING": "tool_moving", "SETTLING": "settling", "MOTION_UNSTABLE": "motion_unstable", "CAMERA_ERROR": "camera_error"}

Emit = Callable[..., None]


@dataclass(frozen=True)
class Rule:
    """Columns of an event behind ns and seq, what a new key holds, the step, and the columns of an emitted row behind device_id."""

    columns: tuple[str, ...]
    fresh: Any
    step: Callable[[Any, tuple, Emit], Any]
    out: str


#: Rows of several keys that go out together; a table for each key would cost more than its rows.
ROWS_OUT = 20_000


def _walk(rule: Rule, key: Any, held: Any, events: Iterable[tuple]) -> tuple[Any, list[tuple]]:
    rows: list[tuple] = []
    for event in events:
        held = rule.step(held, event, lambda *values: rows.append((key, *values)))
    return held, rows


def _table(rule: Rule, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["device_id", *(part.split()[0] for part in rule.out.split(", "))])


def _in_order(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState, rule: Rule) -> Iterator[pd.DataFrame]:
    held, waiting = pickle.loads(state.get[0]) if state.exists else (rule.fresh, [])
    for batch in batches:
        waiting += zip(*(batch[n].tolist() for n in ("ns", "seq", *rule.columns)))
    waiting.sort(key=lambda e: e[:2])
    passed = state.getCurrentWatermarkMs()
    n = bisect_right(waiting, passed * 1_000_000, key=lambda e: e[0])
    held, rows = _walk(rule, key[0], held, waiting[:n])
    state.update((pickle.dumps((held, waiting[n:])),))
    if len(waiting) > n:
        state.setTimeoutTimestamp(max(passed + 1, waiting[n][0] // 1_000_000))
    if rows:
        yield _table(rule, rows)


def ordered(events: DataFrame, rule: Rule, *, delay: str = "1 hour") -> DataFrame:
    """Rows of the rule over a stream with device_id, ns, seq and the rule's columns; equal times go in order of seq."""
    kind = events.schema["device_id"].dataType.simpleString()
    timed = events.select("device_id", "ns", "seq", *rule.columns, F.timestamp_micros(F.expr("ns div 1000")).alias("__at"))
    return timed.withWatermark("__at", delay).groupBy("device_id").applyInPandasWithState(
        partial(_in_order, rule=rule), f"device_id {kind}, {rule.out}", "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def _finished(batches: Iterable[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for key, blob in zip(batch["device_id"].tolist(), batch["held"]):
            rows += _walk(rule, key, *pickle.loads(blob))[1]
            if len(rows) >= ROWS_OUT:
                yield _table(rule, rows)
                rows = []
    if rows:
        yield _table(rule, rows)


def still_waiting(state: DataFrame, rule: Rule, kind: str) -> DataFrame:
    """Rows of the events that wait in the state of an ended stream, as read from its checkpoint."""

    kept = state.select(F.col("key.*"), F.col("value.groupState.held").alias("held")).toDF("device_id", "held")
    return kept.mapInPandas(partial(_finished, rule=rule), f"device_id {kind}, {rule.out}")


def replay(events: DataFrame, rule: Rule, name: str, *, delay: str = "1 hour") -> DataFrame:
    """All rows of a stream that has an end: those it has emitted and those of the events left waiting."""
    spark, path = events.sparkSession, scratch_path(events.sparkSession, name)
    stream = ordered(events, rule, delay=delay)
    manifest_sink(stream, f"{path}/table", f"{path}/checkpoint", form="parquet").awaitTermination()
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    left = still_waiting(state, rule, events.schema["device_id"].dataType.simpleString())
    return spark.read.schema(stream.schema).parquet(f"{path}/table").unionByName(left)


def _known(value: Any) -> Any:
    """None for what pandas gives for a null."""
    return None if value is None or (isinstance(value, float) and value != value) else value


def motion(picture: Any, last: Any) -> float:
    """Mean absolute difference of two thumbnails, cell by cell; without a last one or of another size it is infinite."""
    if last is None or len(picture) != len(last):
        return float("inf")
    return float(np.mean(np.abs(np.asarray(picture, float) - np.asarray(last, float)))) if len(picture) else 0.0


@dataclass(frozen=True)
class InterlockLimits:
    discard: int = 8
    settle_ms: float = 300.0
    stable: int = 3
    max_motion: float = 2.5
    timeout_ms: float = 2000.0


@dataclass(frozen=True)
class Camera:
    """Run state, stop time, frames discarded, calm frames, last picture (None before a baseline), timed out."""

    state: str = READY
    stop: int = 0
    seen: int = 0
    calm: int = 0
    last: Any = None
    late: bool = False

    def command(self, kind: str, ns: int) -> Camera:
        if kind == "start":
            return Camera(MOVING)
        return Camera(SETTLING, ns) if kind == "stop" and self.state == MOVING else self

    def observe(self, picture: Any, ns: int, limits: InterlockLimits) -> Camera:
        """A frame counts while settling only: for the time-out, as discarded, as baseline, or as calm or not."""
        if self.state != SETTLING or picture is None:
            return self
        waited, rest = (ns - self.stop) / 1e6, (self.state, self.stop)
        if waited > limits.timeout_ms:
            return Camera(*rest, self.seen, self.calm, self.last, True)
        if self.seen < limits.discard:
            return Camera(*rest, self.seen + 1, self.calm, None, self.late)
        if waited < limits.settle_ms or self.last is None:
            return Camera(*rest, self.seen, self.calm, picture, self.late)
        calm = self.calm + 1 if motion(picture, self.last) <= limits.max_motion else 0
        done = calm >= limits.stable
        return Camera(READY if done else SETTLING, self.stop, self.seen, calm, picture, self.late and not done)


def _joined_status(cameras: list[Camera]) -> tuple[str, str]:
    states = [c.state for c in cameras]
    if MOVING in states:
        return MOVING, "BUSY_MOVING"
    if SETTLING in states:
        return SETTLING, "MOTION_UNSTABLE" if any(c.state == SETTLING and c.late for c in cameras) else "SETTLING"
    return READY, "OK"


def interlock_rule(limits: InterlockLimits = InterlockLimits()) -> Rule:
    """State of one or two cameras after every event.

    Events: kind (start, stop, frame, error), primary and side (thumbnails of a frame as arrays; a null side is a missing
    camera and is ignored until it is back, a null primary shows nothing).
    """

    def step(held: tuple, event: tuple, emit: Emit) -> tuple:
        primary, side, paired = held
        ns, seq, kind, first, second = event
        if kind in ("start", "stop"):
            primary, side = primary.command(kind, ns), side.command(kind, ns)
        elif kind == "frame":
            primary = primary.observe(_known(first), ns, limits)
            paired = _known(second) is not None
            side = side.observe(_known(second), ns, limits)
        run, status = _joined_status([primary, side] if paired else [primary])
        if kind == "error":
            status = "CAMERA_ERROR"
        emit(ns, seq, kind, run, status, REASONS[status], run == READY and kind != "error")
        return primary, side, paired

    out = "ns bigint, seq bigint, kind string, run_state string, status string, reason string, can_compute boolean"
    return Rule(("kind", "primary", "side"), (Camera(), Camera(), True), step, out)


#: Class, place and count of consecutive frames of the selected target.
NO_TRACK = (None, 0.0, 0.0, 0)


def _advance(track: tuple, selected: bool, name: str | None, x: float, y: float, max_move: float) -> tuple:
    if not selected:
        return NO_TRACK
    same = track[0] is not None and track[0] == name and float(np.hypot(track[1] - x, track[2] - y)) <= max_move
    return (name, float(x), float(y), track[3] + 1 if same else 1)


def stability_rule(*, frames: int = 2, max_move: float = 3.0) -> Rule:
    """Consecutive frames with the same target in place; any other kind of event resets the count.

    Events: kind (frame, or start, acknowledge, unhealthy), selected, class_key, x, y.
    """

    def step(track: tuple, event: tuple, emit: Emit) -> tuple:
        ns, seq, kind, selected, name, x, y = event
        selected = kind == "frame" and bool(_known(selected))
        track = _advance(track, selected, name, x, y, max_move)
        if kind == "frame":
            emit(ns, seq, track[3], selected and track[3] >= max(1, frames))
        return track

    return Rule(("kind", "selected", "class_key", "x", "y"), NO_TRACK, step, "ns bigint, seq bigint, stable_count int, stable_selected boolean")


def gated_rule(limits: InterlockLimits = InterlockLimits(), *, frames: int = 2, max_move: float = 3.0) -> Rule:
    """Detections of frames taken while ready; a read error or a motion start also forgets the target.

    Events: kind and primary as in :func:`interlock_rule`, and selected, class_key, x, y.
    """

    def step(held: tuple, event: tuple, emit: Emit) -> tuple:
        camera, track = held
        ns, seq, kind, picture, selected, name, x, y = event
        if kind in ("error", "start"):
            track = NO_TRACK
        if kind in ("start", "stop"):
            camera = camera.command(kind, ns)
        elif kind == "frame":
            camera = camera.observe(_known(picture), ns, limits)
            if camera.state == READY:
                selected = bool(_known(selected))
                track = _advance(track, selected, name, x, y, max_move)
                emit(ns, seq, name, selected and track[3] >= max(1, frames))
        return camera, track

    columns = ("kind", "primary", "selected", "class_key", "x", "y")
    return Rule(columns, (Camera(), NO_TRACK), step, "ns bigint, seq bigint, class_key string, selected boolean")


def quality_rule(*, max_motion: float = 2.5) -> Rule:
    """Motion against the last frame and calm frames in a row; events: picture (thumbnail), valid_ratio, sync_ms."""

    def step(held: tuple, event: tuple, emit: Emit) -> tuple:
        last, calm = held
        ns, seq, picture, valid, sync = event
        moved = motion(picture, last)
        calm = calm + 1 if moved <= max_motion else 0
        emit(ns, seq, None if moved == float("inf") else moved, calm, valid, sync)
        return picture, calm

    out = "ns bigint, seq bigint, motion double, stable_frames int, valid_ratio double, sync_ms double"
    return Rule(("picture", "valid_ratio", "sync_ms"), (None, 0), step, out)


def with_readiness(counted: DataFrame, *, required: int = 3, min_valid: float = 0.85, max_sync: float = 50.0) -> DataFrame:
    """Adds the reasons against a capture and whether there are none."""
    from framelake.operators.projections import capture_rejections

    reasons = capture_rejections(
        stable_frames=F.col("stable_frames"), valid_ratio=F.col("valid_ratio"), sync_ms=F.col("sync_ms"),
        required_stable=required, min_valid=min_valid, max_sync=max_sync,
    )
    return counted.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)


def capture_rule(*, target: int) -> Rule:
    """Takes ready frames of a scene until the target, then no more (device_id is the scene's key); events: ready."""

    def step(taken: int, event: tuple, emit: Emit) -> int:
        ns, seq, ready = event
        if not _known(ready) or taken >= target:
            return taken
        emit(ns, seq, taken + 1)
        return taken + 1

    return Rule(("ready",), 0, step, "ns bigint, seq bigint, capture_index bigint")


def stretch_rule() -> Rule:
    """Stretches from the first start to the next stop of each device; events: kind."""

    def step(since: int | None, event: tuple, emit: Emit) -> int | None:
        ns, _, kind = event
        if kind == "start":
            return ns if since is None else since
        if kind == "stop" and since is not None:
            emit(since, ns)
            return None
        return since

    return Rule(("kind",), None, step, "start_ns bigint, stop_ns bigint")


def _latest(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    shown = tuple(state.get) if state.exists else (-(1 << 62), -(1 << 62))
    best = max(((int(ns), int(seq)) for b in batches for ns, seq in zip(b["ns"], b["seq"])), default=shown)
    if best > shown:
        state.update(best)
        yield pd.DataFrame([(key[0], *best)], columns=["device_id", "ns", "seq"])


def latest_only(events: DataFrame) -> DataFrame:
    """Newest frame of each device and trigger, the largest seq of equal times; superseded and older frames are dropped.

    What is superseded is a matter of triggers: a viewer gets one frame for each, whatever it has missed.
    """
    kind = events.schema["device_id"].dataType.simpleString()
    return events.select("device_id", "ns", "seq").groupBy("device_id").applyInPandasWithState(
        _latest, f"device_id {kind}, ns bigint, seq bigint", "ns bigint, seq bigint", "append", GroupStateTimeout.NoTimeout
    )
