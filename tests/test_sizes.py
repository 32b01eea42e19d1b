"""What must not grow with the size of a group, and results where a group is large."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import calibrate, extensions, graphs, neighbors, points
from framelake.plans import boxes


def test_nearest_holds_tiles_and_not_all_distances():
    rng = np.random.default_rng(1)
    points, vectors = rng.normal(size=(300, 8)), rng.normal(size=(30_000, 8))
    ends, tags = np.array([10, 20_000, 30_000]), np.arange(30_000)
    scales = rng.uniform(0.5, 2.0, size=(300, 8, 2))
    tracemalloc.start()
    got = neighbors._smallest(points, 1.0 / 8 / scales, vectors, ends, "l1", 3, 1_000, np.arange(300), tags)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6, "300 x 30,000 distances alone would take 72 MB"
    for i in (0, 15, 299):
        for w in range(2):
            far = (np.abs(vectors - points[i]) / scales[i, :, w]).mean(axis=1)
            far[i] = np.inf
            for c, (a, b) in enumerate(zip([0, *ends], ends)):
                assert got[c, w, i] == pytest.approx(np.sort(far[a:b])[:3])


@pytest.mark.parametrize("tag,scaled", [(None, False), ("id", True), ("batch", True), ("batch", False)])
def test_bounds_lose_no_neighbour(monkeypatch, tag, scaled):
    """Bounded by products, few distances are taken, and the smallest are those of the direct search."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(4_000, 32)) * np.r_[0.0, rng.uniform(0.1, 50.0, size=31)]
    vectors[7:900:7] = vectors[8]
    points, ends = np.concatenate([vectors[:290], vectors[:10] * 100]), np.array([2, 2, 1_500, 4_000])
    factors = (rng.uniform(0.97, 1.03, size=(300, 32, 2)) if scaled else np.ones((1, 32, 1))) / 32 / np.maximum(vectors.std(axis=0), 1e-4)[:, None]
    own, tags = {None: (None, None), "id": (np.arange(300), np.arange(4_000)), "batch": (np.arange(300) % 4, np.arange(4_000) % 4)}[tag]
    compared = []
    monkeypatch.setattr(np, "lexsort", lambda keys, f=np.lexsort: compared.append(len(keys[0])) or f(keys))
    for tile in (100, 2_048):
        assert neighbors._boundable(points, factors, vectors)
        got = neighbors._smallest_bounded(points, factors, vectors, ends, 3, tile, own, tags)
        expected = neighbors._smallest(points, factors, vectors, ends, "l1", 3, 1_024, own, tags)
        np.testing.assert_allclose(got, expected, rtol=1e-12, atol=1e-12)
    assert sum(compared) < 0.2 * 2 * factors.shape[2] * 300 * 4_000
    assert not neighbors._boundable(points, -factors, vectors) and not neighbors._boundable(points, factors, np.where(vectors > 60, np.nan, vectors))


@pytest.mark.parametrize("metric,groups", [("l1", None), ("l2", None), ("l2", ([0, 0, 1], [1.0, 3.0]))])
def test_blocks_compare_everything(spark, monkeypatch, metric, groups):
    monkeypatch.setattr(neighbors, "SENT_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(i, f"c{i % 3}", [float(x) for x in rng.normal(size=3)], "odd" if i % 2 else "even") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>, batch string")
    near = neighbors.nearest_per_class(
        df.select(F.col("id").alias("qid"), "v", F.col("batch").alias("tag")), df.select("v", "label", F.col("batch").alias("tag")),
        k=2, metric=metric, exclude="tag", groups=groups, block_rows=3,
    )
    got = {(r["qid"], r["label"]): r["distances"] for r in near.collect()}
    for i, _, v, batch in rows:
        for c in ("c0", "c1", "c2"):
            gaps = [np.abs(np.subtract(v, o)) for _, label, o, tag in rows if label == c and tag != batch]
            if metric == "l1":
                far = [g.mean() for g in gaps]
            elif groups is None:
                far = [np.sqrt((g**2).mean()) for g in gaps]
            else:
                far = [np.sqrt(((g[:2] ** 2).mean() + 3.0 * g[2] ** 2) / 4.0) for g in gaps]
            assert got[i, c] == pytest.approx(sorted(far)[:2])


def test_bundle_fingerprint_passes_the_range_of_a_long(spark):
    rows = 70_000
    df = spark.range(rows).select(F.col("id").alias("sample"), F.lit("train").alias("split"), F.lit("f" * 64).alias("sha256"))
    got = calibrate.bundle_manifest(df).first()
    assert got["fingerprint"] == str(rows * (16**12 - 1)) and got["rows"] == rows and got["contents"] == 1 and got["clean"]


def _gap(a, b):
    return float(np.hypot(max(b[0] - a[0] - a[2], a[0] - b[0] - b[2], 0), max(b[1] - a[1] - a[3], a[1] - b[1] - b[3], 0)))


@pytest.mark.parametrize("few", [0, 12, 100])
def test_gaps_of_small_and_large_keys(spark, few):
    rng = np.random.default_rng(5)
    rows = [(k, f"{i}", *map(float, rng.integers(0, 3000, 2)), *map(float, rng.integers(1, 30, 2))) for k, n in ((1, 1), (2, 12), (3, 60)) for i in range(n)]
    rows += [(3, "same", *rows[-1][2:]), (2, "far", 90_000.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "f int, id string, x double, y double, w double, h double")
    got = {(r["f"], r["id"]): r["clearance"] for r in boxes.nearest_gap(df, ["f"], few=few).collect()}
    assert len(got) == len(rows)
    for r in rows:
        gaps = [_gap(r[2:], o[2:]) for o in rows if o[0] == r[0] and o[1] != r[1]]
        assert got[r[:2]] == (pytest.approx(min(gaps)) if gaps else None)


def test_small_keys_are_not_copied_into_cells(spark):
    df = spark.createDataFrame([(i // 4, float(i % 4) * 9, 0.0, 2.0, 2.0) for i in range(40)], "f int, x double, y double, w double, h double")
    plan = boxes.nearest_gap(df, ["f"])._jdf.queryExecution().optimizedPlan().toString()
    assert "cu#" not in plan and "sequence(" not in plan


def test_local_plane_meets_tiles_and_sends_nothing_whole(spark):
    rng = np.random.default_rng(6)
    pixels = [(f, u, v, float(rng.uniform(300, 500)) if rng.random() > 0.2 else None) for f in ("a", "b") for u in range(45) for v in range(0, 45, 3)]
    grid = spark.createDataFrame(pixels, "f string, u long, v long, depth double")
    spots = [("a", i, int(u), int(v)) for i, (u, v) in enumerate(rng.integers(-2, 47, (60, 2)))] + [("c", 0, 5, 5)]
    candidates = spark.createDataFrame(spots, "f string, c int, cu0 long, cv0 long")
    out = points.local_plane(candidates, grid, ["f"], "c", radius=5, intrinsics={"fx": 600.0, "fy": 610.0, "cx": 20.0, "cy": 20.0})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan, "a join's side whose copies the planner cannot count may be broadcast"
    got = {r["c"]: r for r in out.collect()}
    for f, c, u0, v0 in spots[:-1]:
        near = [(u, v, d) for g, u, v, d in pixels if g == f and (u - u0) ** 2 + (v - v0) ** 2 <= 25]
        cloud = np.array([((u - 20) / 600 * d, (v - 20) / 610 * d, d) for u, v, d in near if d])
        if len(cloud) < 3:
            assert c not in got
            continue
        values, vectors = np.linalg.eigh(np.cov(cloud.T, bias=True))
        normal = vectors[:, 0] * (-1 if vectors[2, 0] > 0 else 1)
        assert (got[c]["points"], got[c]["valid_ratio"]) == (len(cloud), pytest.approx(len(cloud) / len(near)))
        assert [got[c][n] for n in ("nx", "ny", "nz")] == pytest.approx(list(normal), abs=1e-6)
        assert got[c]["rmse"] == pytest.approx(np.sqrt(max(values[0], 0)), abs=1e-5)
    assert {r["f"] for r in got.values()} == {"a"}


@pytest.mark.parametrize("block", [3, 5, 1_000])
def test_faces_of_one_cell_count_like_given_pairs(spark, block):
    rng = np.random.default_rng(7)
    normals = rng.normal(size=(40, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    rows = [(f"o{i % 2}", i, i * 10, 0.1 * i, *map(float, n), int(i % 7 // 3)) for i, n in enumerate(normals)] + [("lone", 99, 1, 0.0, 0.0, 0.0, 1.0, 5)]
    faces = spark.createDataFrame(rows, "o string, face long, area long, rmse double, nx double, ny double, nz double, cell int")
    right = faces.select("o", "cell", F.col("face").alias("b"))
    pairs = faces.select("o", "cell", F.col("face").alias("a")).join(right, ["o", "cell"]).filter("a < b").drop("cell")
    want = {r["o"]: r.asDict() for r in graphs.face_features(faces, pairs, ["o"]).collect()}
    got = {r["o"]: r.asDict() for r in graphs.face_features(faces, "cell", ["o"], block=block).collect()}
    assert set(got) == set(want) == {"o0", "o1", "lone"} and want["o0"]["triple_junctions"] > 0
    for o, found in got.items():
        for name in set(found) - {"o"}:
            assert found[name] == pytest.approx(want[o][name], abs=1e-9), name


def test_instance_model_sees_small_batches(spark):
    def found(pdf):
        return pdf.loc[pdf.index.repeat(pdf["n"])].assign(seen=len(pdf))[["sample", "seen"]]

    df = spark.range(0, 1_000, 1, 1).select(F.col("id").alias("sample"), (F.col("id") % 3).alias("n"))
    rows = extensions.instance_model(df, found, "sample bigint, seen bigint").groupBy("sample").agg(F.count("*").alias("n"), F.max("seen").alias("seen")).collect()
    assert {r["sample"]: r["n"] for r in rows} == {i: i % 3 for i in range(1_000) if i % 3} and max(r["seen"] for r in rows) <= 128


@pytest.mark.parametrize("block", [4, 2_048])
def test_overlaps_of_a_crowded_key_without_rows_of_pairs(spark, block):
    rng = np.random.default_rng(9)
    rows = [(k, i, *map(float, rng.integers(0, 150, 2)), *map(float, rng.integers(0, 60, 2))) for k, n in ((1, 1), (2, 50)) for i in range(n)]
    rows += [(2, 50, *rows[3][2:]), (2, 51, 900.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "f int, id int, x double, y double, w double, h double")
    found = boxes.max_overlap(df, ["f"], block=block)
    assert "a_x" not in found._jdf.queryExecution().optimizedPlan().toString(), "pairs joined as rows"
    got = {(r["f"], r["id"]): r["overlap"] for r in found.collect()}
    assert len(got) == len(rows)
    for f, i, x, y, w, h in rows:
        want = 0.0
        for g, j, u, v, p, q in rows:
            if f == g and i != j and min(w * h, p * q) > 1e-6:
                want = max(want, max(min(x + w, u + p) - max(x, u), 0) * max(min(y + h, v + q) - max(y, v), 0) / min(w * h, p * q))
        assert got[f, i] == pytest.approx(want)


def test_dense_boxes_are_sent_once(spark, monkeypatch):
    """Boxes covered fully by one near them are not sent to every block of their cell, and the rest is compared with all."""
    rng = np.random.default_rng(11)
    rows = [(1, i, *map(float, rng.integers(0, 40, 2)), *map(float, rng.integers(1, 40, 2))) for i in range(1_500)]
    rows += [(1, 1_500, 500.0, 0.0, 4.0, 4.0), (1, 1_501, 502.0, 1.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "f int, id int, x double, y double, w double, h double")
    sent = []
    monkeypatch.setattr(boxes, "_dealt", lambda d, *by, f=boxes._dealt: sent.append(d.count()) or f(d, *by))
    got = {r["id"]: r["overlap"] for r in boxes.max_overlap(df, ["f"], cell=1_000.0, block=200).collect()}
    assert max(sent) < 2 * len(rows), "each row went to all eight blocks"
    assert got[1_500] == got[1_501] == pytest.approx(2 * 3 / 16)
    x, y, w, h = np.array([r[2:] for r in rows]).T
    for i in range(0, 1_500, 50):
        wide = np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x)
        high = np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y)
        share = np.maximum(wide, 0) * np.maximum(high, 0) / np.minimum(w[i] * h[i], w * h)
        share[i] = 0
        assert got[i] == pytest.approx(share.max())
