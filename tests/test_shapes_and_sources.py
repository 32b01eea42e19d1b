"""Convex polygons, sample trees, numbered parts and windows of live health."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.plans import boxes
from framelake.sources import manifest
from framelake.streaming import pairing

POINTS = "array<struct<x:double,y:double>>"


def turned(x, y, w, h, t, back=False):
    corners = [(x + a * w * math.cos(t) - b * h * math.sin(t), y + a * w * math.sin(t) + b * h * math.cos(t)) for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]
    return corners[::-1] if back else corners


def inside(polygon, x, y):
    signs = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(polygon, polygon[1:] + polygon[:1])]
    return all(s >= 0 for s in signs) or all(s <= 0 for s in signs)


def common_area(a, b, steps=400):
    """By counting cells, without any clipping."""
    xs, ys = [p[0] for p in a], [p[1] for p in a]
    dx, dy = (max(xs) - min(xs)) / steps, (max(ys) - min(ys)) / steps
    cells = ((min(xs) + (i + 0.5) * dx, min(ys) + (j + 0.5) * dy) for i in range(steps) for j in range(steps))
    return sum(inside(a, *c) and inside(b, *c) for c in cells) * dx * dy


def test_common_area_of_turned_boxes(spark):
    rng = random.Random(1)
    cases = [(turned(0, 0, 10, 4, rng.random() * 3), turned(rng.randrange(-5, 6), rng.randrange(-4, 5), 6, 5, rng.random() * 3, i % 2)) for i in range(6)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], f"i int, a {POINTS}, b {POINTS}")
    got = {r["i"]: r["o"] for r in df.select("i", F.abs(G.signed_area(G.clipped_polygon(F.col("a"), F.col("b")))).alias("o")).collect()}
    for i, (a, b) in enumerate(cases):
        assert got[i] == pytest.approx(common_area(a, b), abs=0.3)


def test_known_overlaps(spark):
    square = turned(0, 0, 2, 2, 0)
    diamond = turned(0, 0, math.sqrt(2), math.sqrt(2), math.pi / 4)
    triangle = [(-1.0, -1.0), (1.0, -1.0), (-1.0, 1.0)]
    rows = [(square, square, 1.0), (square, diamond, 1.0), (square, triangle, 1.0), (triangle, [(1.0, 1.0), (-1.0, 1.0), (1.0, -1.0)], 0.0),
            (square, turned(5, 5, 1, 1, 0.3), 0.0), (square, turned(1, 0, 2, 2, 0, True), 0.5), (square, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 0.0)]
    df = spark.createDataFrame(rows, f"a {POINTS}, b {POINTS}, e double")
    for r in df.select("e", G.polygon_overlap(F.col("a"), F.col("b")).alias("ab"), G.polygon_overlap(F.col("b"), F.col("a")).alias("ba")).collect():
        assert (r["ab"], r["ba"]) == (pytest.approx(r["e"], abs=1e-9), pytest.approx(r["e"], abs=1e-9))


@pytest.mark.parametrize("cell", [3.0, 500.0])
def test_largest_overlap_does_not_depend_on_cells(spark, cell):
    rng = random.Random(2)
    shapes = [(k, i, turned(rng.random() * 40, rng.random() * 40, 9, 3, rng.random() * 3)) for k in "ab" for i in range(30)]
    shapes += [("a", 30, shapes[0][2]), ("c", 0, shapes[0][2])]
    df = spark.createDataFrame(shapes, f"k string, i int, polygon {POINTS}")
    pairs = df.alias("p").join(df.alias("q"), (F.col("p.k") == F.col("q.k")) & (F.col("p.i") != F.col("q.i"))).groupBy("p.k", "p.i").agg(
        F.max(G.polygon_overlap(F.col("p.polygon"), F.col("q.polygon"))).alias("o")
    )
    expected = {(r["k"], r["i"]): r["o"] for r in pairs.collect()} | {("c", 0): 0.0}
    got = {(r["k"], r["i"]): r["overlap"] for r in boxes.max_polygon_overlap(df, ["k"], cell=cell).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}


@pytest.mark.parametrize("block", [100, 2_048])
def test_dense_polygons_are_compared_in_arrays(spark, block):
    rng = random.Random(3)
    shapes = [(i, turned(rng.random() * 90, rng.random() * 90, 4 + rng.random() * 20, 4 + rng.random() * 9, rng.random() * 3, i % 2)) for i in range(700)]
    shapes += [(700 + i, [(x, y), (x + 9, y), (x, y + 9)]) for i, (x, y) in enumerate([(0.0, 0.0), (40.0, 40.0), (400.0, 400.0)])]
    df = spark.createDataFrame(shapes, f"i int, polygon {POINTS}").withColumn("k", F.lit("a"))
    some = df.filter("i % 60 = 0 or i >= 700").select(F.col("i").alias("j"), F.col("polygon").alias("p"))
    expected = some.join(df, F.col("i") != F.col("j")).groupBy("j").agg(F.max(G.polygon_overlap(F.col("p"), F.col("polygon"))).alias("o"))
    found = boxes.max_polygon_overlap(df, ["k"], cell=64.0, block=block)
    got = {r["i"]: r["overlap"] for r in found.collect()}
    assert len(got) == 703 and got[702] == 0.0
    assert {r["j"]: r["o"] for r in expected.collect()} == {i: pytest.approx(got[i], abs=1e-9) for i in got if i % 60 == 0 or i >= 700}
    # Pairs are no rows: polygons are joined with their own results only.
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_every_metadata_file_decides(spark, tmp_path):
    for i in range(12):
        folder = tmp_path / "batch-01" / ("cone" if i % 2 else "cube") / f"s{i}"
        folder.mkdir(parents=True)
        text = "{broken" if i == 7 else json.dumps({"label_id": "ball"} if i == 4 else {"split": "train"})
        (folder / "metadata.json").write_text(text)
    found = {r["sample_dir"].rsplit("/", 1)[1]: (r["raw_label"], r["reason"]) for r in manifest.scan_samples(spark, str(tmp_path)).collect()}
    assert len(found) == 12 and found["s7"] == ("cone", "invalid_metadata") and found["s4"] == ("ball", "ok") and found["s2"] == ("cube", "ok")


def test_numbers_run_through_sorted_parts(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("value")).write.text(path)
    rows = manifest.numbered_lines(spark, path, through=True).collect()
    assert sorted((r["line_number"], int(r["line"])) for r in rows) == [(i + 1, i) for i in range(1000)]
    assert len({r["path"] for r in rows}) == 7


def test_open_windows_come_out_at_the_end(spark):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "d", float(d * h), h % 2 == 0) for d in (1, 2, 3) for h in range(1, 9)]
    events = spark.createDataFrame(rows, "at string, device_id string, latency_ms double, ok boolean").withColumn("ts", F.to_timestamp("at"))
    whole = pairing.live_health(events)
    first = whole.orderBy("window_us").limit(1)
    out = pairing.with_open_windows(first, events).orderBy("window_us").collect()
    assert [(r["frames"], r["failures"], r["max_ms"]) for r in out] == [(8, 4, 8.0), (8, 4, 16.0), (8, 4, 24.0)]
    assert [round(r["p95_ms"], 6) for r in out] == [7.65, 15.3, 22.95]
