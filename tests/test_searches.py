"""Ordered and exhaustive searches against sequential and brute-force versions."""

from __future__ import annotations

import random

import pytest

from framelake.operators import calibrate, pairing


def one_to_one(primary, side):
    used, out = -1, {}
    for ns, pid in sorted(primary):
        left = range(used + 1, len(side))
        pick = min(left, key=lambda i: (abs(side[i][0] - ns), i), default=None)
        out[pid] = None if pick is None else side[pick][1]
        used = used if pick is None else pick
    return out


@pytest.mark.parametrize("bucket", [3, 50, 10_000])
def test_one_to_one_equals_a_walk(spark, bucket):
    rng = random.Random(bucket)
    primary = [(k, rng.randrange(300), 1000 + i) for i, k in enumerate(rng.choices("abcd", k=240))]
    side = [(k, rng.randrange(300), i) for i, k in enumerate(rng.choices("abc", k=150))]
    frames = [spark.createDataFrame(x, "k string, ns bigint, frame_id bigint") for x in (primary, side)]
    got = {r["primary_id"]: r["side_id"] for r in pairing.pair_one_to_one(*frames, ["k"], bucket_ns=bucket).collect()}
    expected = {}
    for k in "abcd":
        expected |= one_to_one([r[1:] for r in primary if r[0] == k], sorted(r[1:] for r in side if r[0] == k))
    assert got == expected
    assert sum(v is not None for v in got.values()) > 100 and None in got.values()


def best_limits(rows):
    usable = [r for r in rows if r[2] is not None and r[2] < float("inf")]
    distances = sorted({0.0, *(r[2] for r in usable)})
    margins = sorted({0.0, 0.4, *(r[3] or 0.0 for r in rows)})
    labels = {r[0] for r in rows}
    found = []
    for d in distances:
        for m in margins:
            taken = [r for r in usable if r[2] <= d and (r[3] or 0.0) >= m]
            wrong = sum(r[0] != r[1] for r in taken)
            recalls = [sum(r[0] == r[1] == y for r in taken) / sum(r[0] == y for r in rows) for y in labels]
            found.append((wrong, -round(sum(recalls) / len(recalls), 9), -round(len(taken) / len(rows), 9), d, -m))
    wrong, recall, coverage, d, m = min(found)
    return d, -m, wrong, -recall, -coverage


@pytest.mark.parametrize("n,seed", [(1, 0), (12, 1), (60, 2), (199, 3), (201, 4), (120, 5)])
def test_limits_over_all_observed_values(spark, n, seed):
    rng = random.Random(seed)
    coarse = seed in (1, 5)
    value = lambda top: rng.randrange(8) * top / 8 if coarse else round(rng.random() * top, 6)
    rows = []
    for i in range(n):
        truth = rng.choice("abc")
        right = rng.random() < 0.8
        rows.append((truth, truth if right else rng.choice("abc"), value(1.0) + (0 if coarse else i * 1e-9), value(0.5)))
    if n > 10:
        rows[3] = ("a", "b", None, 0.9)
        rows[4] = ("a", "a", float("inf"), None)
        rows[5] = ("b", None, 0.3, 0.2)
    df = spark.createDataFrame(rows, "truth string, prediction string, distance double, margin double").repartition(3)
    got = calibrate.fit_thresholds(df).first()
    expected = best_limits(rows)
    assert (got["distance_threshold"], got["margin_threshold"], got["wrong_accepts"]) == expected[:3]
    assert (round(got["macro_recall"], 9), round(got["coverage"], 9)) == expected[3:]


def test_limits_of_nothing(spark):
    assert calibrate.fit_thresholds(spark.createDataFrame([], "truth string, prediction string, distance double, margin double")).count() == 0
