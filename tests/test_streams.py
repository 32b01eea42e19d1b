"""Scripted events through the stateful operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.session import scratch_path
from framelake.streaming import stateful as T
from framelake.streaming.common import run_to_table

MS = 1_000_000
#: A first watermark is the beginning of time; nothing may lie there.
DAY = 86_400_000 * MS
SCHEMA = (
    "device_id string, ns bigint, seq bigint, kind string, primary array<double>, side array<double>, selected boolean, class_key string, "
    "x double, y double, picture array<double>, valid_ratio double, sync_ms double"
)


def stream(spark, rows, files=1):
    full = [(r[0], r[1] + DAY, *r[2:], *[None] * 13)[:13] for r in rows]
    path = scratch_path(spark, "script")
    for i in range(files):
        part = full[i * len(full) // files : (i + 1) * len(full) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def script(*commands, frames=0, first_ms=300, step_ms=10, picture=(10.0, 10.0), side=None):
    rows = [("d", i, i, kind) for i, kind in enumerate(commands)]
    rows += [("d", first_ms * MS + i * step_ms * MS, 100 + i, "frame", list(picture), side) for i in range(frames)]
    return rows


def interlock(spark, rows, limits=T.InterlockLimits(), files=1):
    return T.replay(stream(spark, rows, files), T.interlock_rule(limits), "t").orderBy("ns", "seq").collect()


@pytest.mark.parametrize("files", [1, 3])
def test_twelve_calm_frames_until_ready(spark, files):
    states = [r["run_state"] for r in interlock(spark, script("start", "stop", frames=12), files=files) if r["kind"] == "frame"]
    assert states == ["SETTLING"] * 11 + ["READY"]


def test_time_out_keeps_settling(spark):
    got = interlock(spark, script("start", "stop", frames=20, first_ms=2002))[-1]
    assert (got["run_state"], got["status"], got["can_compute"]) == ("SETTLING", "MOTION_UNSTABLE", False)


def test_commands_are_idempotent(spark):
    assert interlock(spark, script("start", "start", "stop", "stop"))[-1]["status"] == "SETTLING"


def test_worse_camera_decides(spark):
    rows = script("start", "stop") + [("d", (400 + i * 10) * MS, 10 + i, "frame", [9.0], s) for i, s in enumerate(([20.0], [200.0], [200.0], None))]
    out = interlock(spark, rows, T.InterlockLimits(discard=0, stable=1))
    assert [r["run_state"] for r in out][-3:] == ["SETTLING", "READY", "READY"]


def test_moved_content_of_equal_mean_is_not_calm(spark):
    calm = script("start", "stop", frames=3)
    moved = [(*r[:4], [0.0, 20.0] if i % 2 else [20.0, 0.0], None) if r[3] == "frame" else r for i, r in enumerate(calm)]
    limits = T.InterlockLimits(discard=0, stable=1)
    assert [interlock(spark, rows, limits)[-1]["run_state"] for rows in (calm, moved)] == ["READY", "SETTLING"]
    counted = T.replay(
        stream(spark, [("d", i * MS, i, None, None, None, None, None, None, None, p, 1.0, 0.0) for i, p in enumerate(([0.0, 20.0], [20.0, 0.0], [20.0, 0.0], [20.0]))]),
        T.quality_rule(), "t",
    )
    rows = T.with_readiness(counted, required=1).orderBy("seq").collect()
    assert [(r["motion"], r["stable_frames"], r["ready"]) for r in rows] == [(None, 0, False), (20.0, 0, False), (0.0, 1, True), (None, 0, False)]


def test_read_error_blocks_and_forgets(spark):
    frame = lambda i: ("d", i * MS, i, "frame", [1.0], None, True, "a", 1.0, 1.0)
    out = T.replay(stream(spark, [frame(1), frame(2), ("d", 3 * MS, 3, "error"), frame(4), frame(5)]), T.gated_rule(), "t")
    assert {r["seq"]: r["selected"] for r in out.collect()} == {1: False, 2: True, 4: False, 5: True}
    status = interlock(spark, [("d", 3 * MS, 3, "error")])[0]
    assert (status["status"], status["can_compute"]) == ("CAMERA_ERROR", False)


@pytest.fixture(scope="module")
def jumbled():
    """Events of three devices over two hours; each lies in the file at most half an hour from its place."""
    rng = random.Random(3)
    rows = []
    for i in range(360):
        kind = rng.choice(["start", "stop", "frame", "frame", "frame", "frame", "frame", "error"])
        picture = [float(rng.randrange(3)) for _ in range(4)]
        rows.append((rng.choice("abc"), i * 20_000 * MS, i, kind, picture, picture if i % 4 else None, i % 5 > 0, "ab"[i % 7 > 3], float(i % 3), 0.0, picture, 1.0, 0.0))
    return sorted(rows, key=lambda r: r[1] + rng.random() * 1_800_000 * MS)


RULES = {
    "interlock": T.interlock_rule(T.InterlockLimits(discard=1, settle_ms=30_000, stable=1, max_motion=0.8, timeout_ms=200_000)),
    "stability": T.stability_rule(max_move=1.0),
    "gated": T.gated_rule(T.InterlockLimits(discard=0, settle_ms=0, stable=1, max_motion=1.5, timeout_ms=9e9)),
    "quality": T.quality_rule(max_motion=0.8),
    "stretches": T.stretch_rule(),
}


@pytest.mark.parametrize("name", RULES)
def test_cut_and_order_of_files_do_not_matter(spark, jumbled, name):
    """One file, twenty files and a plain walk in order of time give the same rows."""
    rule = RULES[name]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    expected = []
    for device in "abc":
        events = sorted(tuple(r[columns.index(n)] + DAY if n == "ns" else r[columns.index(n)] for n in ("ns", "seq", *rule.columns)) for r in jumbled if r[0] == device)
        held = rule.fresh
        for event in events:
            held = rule.step(held, event, lambda *values: expected.append((device, *values)))
    assert len(expected) > 20
    for files in (1, 20):
        got = [tuple(r) for r in T.replay(stream(spark, jumbled, files), rule, name, delay="40 minutes").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_captures_stop_at_the_target(spark):
    rows = stream(spark, [("d", i * MS, i, "frame") for i in range(9)], files=3).withColumn("ready", F.col("seq") % 2 == 0)
    out = T.replay(rows, T.capture_rule(target=3), "t").orderBy("seq").collect()
    assert [(r["seq"], r["capture_index"]) for r in out] == [(0, 1), (2, 2), (4, 3)]


def test_newest_frame_only(spark):
    out = run_to_table(T.latest_only(stream(spark, [("d", min(i, 2), 9 - i, "frame") for i in range(4)])), "t")
    assert [(r["ns"] - DAY, r["seq"]) for r in out.collect()] == [(2, 7)]


def test_rows_of_many_keys_leave_the_state_together():
    import pickle

    import pandas as pd

    from framelake.streaming import stateful

    rule = stateful.capture_rule(target=2)
    held = [pickle.dumps((0, [(10, 1, True), (20, 2, False), (30, 3, True)])) for _ in range(50)]
    tables = list(stateful._finished([pd.DataFrame({"device_id": range(50), "held": held})], rule))
    assert len(tables) == 1
    assert [tuple(r) for r in tables[0].itertuples(index=False)] == [(k, ns, seq, i) for k in range(50) for ns, seq, i in ((10, 1, 1), (30, 3, 2))]
