"""One pass in place of two: shuffles of signatures, points of an object, tiles of a grid."""

from __future__ import annotations

import io
from contextlib import redirect_stdout


def plan_of(df) -> str:
    said = io.StringIO()
    with redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_signatures_are_shuffled_once(spark, monkeypatch):
    from framelake.llm import jaccard

    monkeypatch.setattr(jaccard, "kept", lambda df, name: df)
    rows = [(1, 2, 10, 10, [5, 6]), (2, 2, 10, 10, [5, 6]), (3, 3, 20, 20, [6, 7]), (4, 0, 30, 30, [6]), (5, 4, 40, 40, [8, 8])]
    described = spark.createDataFrame(rows, "doc_id long, n long, f1 long, f2 long, signatures array<long>")
    groups = jaccard._groups(described)
    assert {tuple(r) for r in groups.collect()} == {(6, 10, 2), (6, 20, 3)}
    assert groups.count() == 2
    assert plan_of(groups).split("Initial Plan")[-1].count("Exchange") == 1


def test_large_and_small_objects_have_the_same_features(spark):
    from framelake.operators import points

    rows = [(k, float(i * i % 17), float(i * 7 % 11) / 3, float("nan") if i == 5 and k == 2 else float(i % 13 + k * i)) for k in (1, 3) for i in range(40 + 5 * k)]
    rows += [(4, 1.0, 2.0, 3.0)] * 5 + [(None, float(i), 1.0, 2.0) for i in range(60)]
    cloud = spark.createDataFrame(rows, "object_id long, x double, y double, z double")
    small, large, both = (
        sorted(tuple(round(v, 9) for v in r) for r in points.object_features(cloud, ["object_id"], few=few).collect()) for few in (1000, 1, 50)
    )
    assert [r[0] for r in small] == [1, 3]
    assert small == large == both


def brute(cells, steps):
    left, found = set(cells), {}
    while left:
        todo, part = [left.pop()], []
        while todo:
            v, u = todo.pop()
            part.append((v, u))
            for dv, du in steps:
                if (v + dv, u + du) in left:
                    left.discard((v + dv, u + du))
                    todo.append((v + dv, u + du))
        found.update(dict.fromkeys(part, min(part)))
    return found


def test_cells_are_labelled_in_tiles(spark, monkeypatch):
    from framelake.operators import graphs

    rows = [(k, u, v) for k in (0, 1) for u in range(-7, 9) for v in range(-6, 8) if (u * 7 + v * 13 + k * u * v) % 5 > 1]
    cells = spark.createDataFrame(rows + rows[:3], "k long, u long, v int")
    handed = []
    rounds = graphs.connected_components
    monkeypatch.setattr(graphs, "connected_components", lambda nodes, edges: handed.append(edges.count()) or rounds(nodes, edges))
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    for tile, diagonal in ((4, True), (64, False)):
        steps = four + [(1, 1), (-1, -1), (1, -1), (-1, 1)] * diagonal
        want = {k: brute([(v, u) for j, u, v in rows if j == k], steps) for k in (0, 1)}
        got = graphs.grid_components(cells, ["k"], diagonal=diagonal, tile=tile).collect()
        assert len(got) == len(rows) + 3
        assert all(tuple(r.component) == want[r.k][(r.v, r.u)] for r in got)
    assert 0 < handed[0] < len(rows)


def test_edges_are_contracted_in_blocks(spark, monkeypatch):
    from framelake.operators import graphs

    rows = [("x", i, i * 3 % 41 + 1) for i in range(0, 60, 4)] + [("y", i, i + 1) for i in range(30) if i % 9]
    edges = spark.createDataFrame([r for r in rows if r[1] != r[2]], "k string, a long, b long")
    nodes = spark.createDataFrame([(k, n) for k in "xyz" for n in range(62)], "k string, node long")
    whole = {(r.k, r.node, r.component) for r in graphs.components_in_groups(nodes, edges, ["k"]).collect()}
    cut = {(r.k, r.node, r.component) for r in graphs.components_in_groups(nodes, edges, ["k"], block=4).collect()}
    assert whole == cut and len(whole) == 186
    assert {c for k, n, c in whole if k == "y" and 1 <= n <= 9} == {1}
    assert {c for k, n, c in whole if k == "z"} == set(range(62))


def test_nodes_meet_their_anchors_in_arrays(spark):
    from framelake.operators import graphs

    def cloud(sign, rows):
        return spark.createDataFrame([("o", sign * i - (sign < 0), *p, [f"s{sign}"]) for i, p in enumerate(rows)], "k string, node long, x double, y double, z double, sources array<string>")

    old = cloud(1, [(i * 3.0 % 11, i * 5.0 % 7, 0.0) for i in range(40)])
    new = cloud(-1, [(i * 3.0 % 11 + i % 3, i * 5.0 % 7 + i % 2, float(i % 5)) for i in range(40)])
    none = spark.createDataFrame([], "k string, a long, b long, sources array<string>")
    out, _ = graphs.augment_graph(old, new, none, none, ["k"])
    cut, _ = graphs.augment_graph(old, new, none, none, ["k"], block=3)
    assert {r.node: tuple(r.sources) for r in out.collect()} == {r.node: tuple(r.sources) for r in cut.collect()}
    assert "FlatMapCoGroupsInArrow" in plan_of(out) and out.count() > 40
