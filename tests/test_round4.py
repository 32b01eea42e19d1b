"""Jobs on pairs and large groups that meet in blocks: the same rows for any size of a block."""

from __future__ import annotations

import math
import random

import pytest

from framelake.operators import joins as J

CAMERA = {"fx": 600.0, "fy": 600.0, "cx": 320.0, "cy": 240.0}


def _on(line, u, v):
    x1, y1, x2, y2 = line
    dx, dy = x2 - x1, y2 - y1
    if dx * dx + dy * dy < 64:
        return None
    t = ((u - x1) * dx + (v - y1) * dy) / (dx * dx + dy * dy)
    near = abs(dx * (v - y1) - dy * (u - x1)) / math.hypot(dx, dy) <= 3
    return t if near and -0.1 <= t <= 1.1 else None


@pytest.mark.parametrize("block", [3, 7, 1_024])
def test_pairs_on_one_line_of_both_views(spark, block):
    rng = random.Random(5)
    spot = lambda: rng.gauss(0, 8)
    nodes = [(o, f"n{i}", *(spot() for _ in range(4)), spot(), spot(), 40 + spot()) for o in "ab" for i in range(40)]
    nodes.append(("a", "hidden", None, 1.0, 2.0, 3.0, 0.0, 0.0, 40.0))
    views = [[(o, k, *(spot() for _ in range(4))) for o in "ab" for k in range(25)] for _ in range(2)]
    views[0].append(("only lines", 1, 0.0, 0.0, 30.0, 0.0))
    expected = set()
    for n in nodes:
        for m in nodes:
            if n[0] != m[0] or not n[1] < m[1] or n[2] is None or m[2] is None:
                continue
            found = []
            for lines, at in zip(views, (2, 4)):
                places = [(line[1], _on(line[2:], *n[at : at + 2]), _on(line[2:], *m[at : at + 2])) for line in lines if line[0] == n[0]]
                hits = [k for k, s, t in places if s is not None and t is not None and abs(s - t) >= 0.5]
                found.append(hits)
            if len(found[0]) == len(found[1]) == 1:
                expected.add((n[0], n[1], m[1], found[0][0], found[1][0]))
    known = spark.createDataFrame(nodes, "o string, node_id string, pu double, pv double, su double, sv double, x double, y double, z double")
    top, side = (spark.createDataFrame(v, "o string, line_id int, x1 double, y1 double, x2 double, y2 double") for v in views)
    out = J.two_view_edges(
        known, top, side, ["o"], camera=CAMERA, rotation=[[0, 0, -1], [0, 1, 0], [1, 0, 0]], translation=[5.0, 0.0, 5.0],
        max_residual=1e9, min_length=0.0, block=block,
    )
    got = {(r["o"], r["a"], r["b"], r["top_line"], r["side_line"]) for r in out.collect()}
    assert len(expected) > 10
    assert got <= expected and len(got) >= len(expected) - 2  # planes that are parallel are no edge


def test_linked_sets_share_a_signature():
    import numpy as np

    from framelake.llm import jaccard

    rng = np.random.default_rng(3)
    for (a, b), n in [(t, n) for t in ((9, 10), (4, 5)) for n in (5, 10, 19, 20, 60, 333, 2_000)]:
        for _ in range(30):
            one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            # The most that a set may lose, or lose and win, and still be linked.
            lost = int(rng.integers(0, n * (b - a) // b + 1))
            won = int(rng.integers(0, max(0, (b * (n - lost)) // a - n) + 1))
            two = np.unique(np.concatenate([rng.permutation(one)[lost:], rng.integers(0, 2**63, won).astype(np.uint64)]))
            both = len(np.intersect1d(one, two))
            assert b * both >= a * (len(one) + len(two) - both)
            values, counts = jaccard.signatures([one, np.zeros(0, np.uint64), two], (a, b))
            assert counts[1] == 0 and len(values) == counts.sum()
            assert set(values[: counts[0]]) & set(values[counts[0] :])


def test_groups_that_go_on_in_the_next_batch(spark, monkeypatch):
    import numpy as np

    from framelake.llm import jaccard

    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    rows, sets = [], {}
    for u in range(24):
        tokens = base[rng.permutation(200)[: 200 - u % 12]]
        sets[u] = set(tokens.tolist())
        for g in {u % 3, 7}:
            rows.append((g, u, u % 5, len(tokens), bytearray(jaccard._sketch(tokens))))
    df = spark.createDataFrame(rows, "g long, u long, label long, n long, sketch binary")
    must = set()
    for g, u, x, *_ in rows:
        for h, v, y, *_ in rows:
            both = len(sets[u] & sets[v])
            if g == h and u < v and x != y and 10 * both >= 9 * (len(sets[u] | sets[v])):
                must.add((u, v))
    labels = {r[1]: r[2] for r in rows}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    try:
        for found in (jaccard._near_in_groups(df, (9, 10)), jaccard._near_in_blocks(df, (9, 10))):
            got = {(r["u"], r["v"]) for r in found.collect()}
            assert must and must <= got
            assert all(labels[u] != labels[v] for u, v in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
