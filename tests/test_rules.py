"""Single rules on small tables with known results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from framelake.functions import labels
from framelake.functions import numeric as N
from framelake.functions import scores as S
from framelake.operators import audits, calibrate, evaluation, joins, pairing, sequences, splits
from framelake.operators import projections as P
from framelake.plans.boxes import max_overlap, nearest_gap
from framelake.plans.quantiles import quantiles


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def score_map(values):
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def test_quantiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.concatenate((rng.normal(size=500), rng.integers(0, 4, 200), -(2.0 ** rng.integers(-8, 9, 100))))
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)], "k int, v double")
    got = {r["k"]: r for r in quantiles(df, ["k"], F.col("v"), {"a": 0.05, "b": 0.5, "c": 0.98}).collect()}
    near = {r["k"]: r["a"] for r in quantiles(df, ["k"], F.col("v"), {"a": 0.95}, method="nearest").collect()}
    for k in range(3):
        part = values[k::3]
        assert [got[k][n] for n in "abc"] == pytest.approx(list(np.percentile(part, [5, 50, 98])))
        assert near[k] == sorted(part)[int(np.ceil(0.95 * len(part))) - 1]


def test_holdout_depends_on_ids_only(spark):
    sizes = {"p": 7, "q": 4, "r": 31}
    rows = [(g, f"{g}{i * i}") for g, n in sizes.items() for i in range(n)]

    def held(table, seed):
        out = splits.group_holdout(table, "g", "id", n=2, seed=seed)
        return {(r["g"], r["id"]) for r in out.filter("role = 'holdout'").collect()}

    table = spark.createDataFrame(rows, "g string, id string")
    one_seed = held(table, 4)
    assert {g: sum(h[0] == g for h in one_seed) for g in sizes} == dict.fromkeys(sizes, 2)
    assert one_seed == held(table.orderBy(F.desc("id")).repartition(6), 4)
    assert len({frozenset(held(table, seed)) for seed in range(5)}) > 1
    # A row more in one group leaves the other groups as they are.
    grown = spark.createDataFrame([*rows, ("q", "extra")], "g string, id string")
    assert {h for h in held(grown, 4) if h[0] != "q"} == {h for h in one_seed if h[0] != "q"}


@pytest.mark.parametrize("n, fails", [(4, False), (5, True)])
def test_strict_holdout_leaves_training_rows(spark, n, fails):
    df = spark.createDataFrame([("x", f"x{i}") for i in range(5)] + [("y", f"y{i}") for i in range(9)], "g string, id string")
    if fails:
        with pytest.raises(ValueError):
            splits.group_holdout(df, "g", "id", n=n, strict=True)
    else:
        out = splits.group_holdout(df, "g", "id", n=n, strict=True)
        assert out.filter("g = 'x' AND role = 'training'").count() == 1


def test_sync_delta_reason(spark):
    got = one(spark, P.capture_rejections(stable_frames=F.lit(5), valid_ratio=F.lit(0.9), sync_ms=F.lit(80.0)))
    assert got == ["rgb_depth_out_of_sync"]


def test_next_incomplete_label(spark):
    names = ["cone", "empty_tray", "triangular_prism"]
    cycle = spark.createDataFrame([("b1", 0, 3, i, n) for i, n in enumerate(names)], "batch string, cur int, n int, idx int, label string")
    counts = spark.createDataFrame([("b1", "empty_tray", 2)], "batch string, label string, captures int")
    assert sequences.next_incomplete_label(cycle, counts, ["batch"], current="cur", target=2).first()["next_label"] == "triangular_prism"


@pytest.mark.parametrize("counts, requested, expected", [({1: 4}, 0, 1), ({1: 10}, 0, 2), ({1: 10, 2: 3}, 0, 2), ({1: 10, 2: 3}, 7, 7)])
def test_next_scene(spark, counts, requested, expected):
    df = spark.createDataFrame([("b", k, v) for k, v in counts.items()], "batch string, scene_index int, captures int")
    assert sequences.next_scene(df, ["batch"], target=10, requested=requested).first()["next_scene"] == expected


def test_pair_frames_nearest_and_one_to_one(spark):
    second = 1_000_000_000
    primary = spark.createDataFrame([("s", 1, 1_012_000_000), ("s", 2, 90 * second), ("t", 3, 5)], "k string, frame_id int, ns bigint")
    side = spark.createDataFrame([("s", 7, second)], "k string, frame_id int, ns bigint")
    got = {r["primary_id"]: r for r in pairing.pair_frames(primary, side, ["k"], bucket_ns=second).collect()}
    assert (got[1]["pair_delta_ms"], got[1]["synchronized"]) == (12.0, True)
    assert (got[2]["side_id"], got[2]["synchronized"]) == (7, False)
    assert got[3]["side_id"] is None and got[3]["synchronized"] is False
    kept = {r["primary_id"]: r["side_id"] for r in pairing.pair_one_to_one(primary, side, ["k"], bucket_ns=second).collect()}
    assert kept == {1: 7, 2: None, 3: None}


def test_unsynchronised_pair_state(spark):
    state = P.fusion_base_state(
        calibration_valid=F.lit(True), side_present=F.lit(True), synchronized=F.lit(False), sizes_match=F.lit(True),
        intrinsics_ok=F.lit(True), platform_ok=F.lit(True), plane_ok=F.lit(True),
    )
    assert one(spark, state) == "UNSYNCED"


def decide(spark, top, side, quality=0.9, *, status, top_reason="accepted", upgrade=False, usable=True):
    decision = S.fusion_decision(
        S.normalize_scores(score_map(top)), S.normalize_scores(score_map(side)), F.lit(quality), top_reason=F.lit(top_reason), side_reason=F.lit("accepted")
    )
    applied = S.apply_decision(
        F.lit(status), F.lit(True), decision, top_reason=F.lit(top_reason), upgrade_allowed=F.lit(upgrade), usable=F.lit(usable),
        top_probability=F.lit(max(top.values()) / sum(top.values())), missing_state=F.lit("SIDE_MISSING"),
    )
    return one(spark, applied)


@pytest.mark.parametrize("p, status", [(0.9, "PICKABLE"), (0.8, "UNCERTAIN")])
def test_missing_side_needs_a_sure_top_view(spark, p, status):
    got = decide(spark, {"cube": p, "cone": 1 - p}, {"cube": 1.0}, status="PICKABLE", usable=False)
    assert (got["status"], got["state"]) == (status, "SIDE_MISSING")


def test_conflict_is_never_selected(spark):
    got = decide(spark, {"cube": 0.9, "cone": 0.1}, {"hexagonal_prism": 0.95, "cube": 0.05}, status="PICKABLE")
    assert (got["status"], got["selected"], got["state"]) == ("UNCERTAIN", False, "CONFLICT")


@pytest.mark.parametrize("reason, status", [("margin_rejected", "PICKABLE"), ("distance_rejected", "UNCERTAIN")])
def test_only_margin_rejection_rises(spark, reason, status):
    got = decide(spark, {"cube": 0.55, "cone": 0.45}, {"cube": 0.99, "cone": 0.01}, 1.0, status="UNCERTAIN", top_reason=reason, upgrade=True)
    assert got["status"] == status


@pytest.mark.parametrize("side", [{"cube": 0.99, "cone": 0.01}, {"cone": 0.99, "cube": 0.01}])
def test_failed_depth_never_changes(spark, side):
    assert decide(spark, {"cube": 0.9, "cone": 0.1}, side, status="DEPTH_INVALID")["status"] == "DEPTH_INVALID"


@pytest.mark.parametrize("method", S.FUSION_METHODS)
def test_fusion_chooses_between_the_two_best(spark, method):
    """Whatever the side view says of a third class, the two best of the primary view share the probability."""
    options = {"weights": (0.7, 0.4, 0.1, -0.3, 0.2), "bias": -0.05} if method == "top2_logistic" else {}
    for shift in range(3):
        top = {name: 1.0 + (i + shift) % 5 for i, name in enumerate("vwxyz")}
        side = {name: 9.0 - top[name] for name in top}
        fused = one(spark, S.fuse(S.normalize_scores(score_map(top)), S.normalize_scores(score_map(side)), F.lit(0.8), method=method, **options))
        assert {e["label"] for e in fused} == set(sorted(top, key=top.get)[-2:])
        assert sum(e["p"] for e in fused) == pytest.approx(1.0) and all(0 < e["p"] < 1 for e in fused)


def adaptive(spark, names, top, side, **options):
    maps = [score_map({names[0]: x, names[1]: 1 - x}) for x in (top, side)]
    return {e["label"]: e["p"] for e in one(spark, S.fuse(*maps, F.lit(1.0), method="evidence_adaptive", side_weight=0.5, **options))}


def test_topology_takes_weight_from_the_side_view(spark):
    """Log odds are a mixture of both views; the side view's share is 0.5 x 0.35 within a family and loses 65 % at full topology."""
    names = ("square_prism", "octagonal_prism")
    for quality, share in ((0.0, 0.175), (0.5, 0.175 * 0.675), (1.0, 0.175 * 0.35)):
        fused = adaptive(spark, names, 0.7, 0.2, topology=F.lit(quality))
        odds = (1 - share) * math.log(0.7 / 0.3) + share * math.log(0.2 / 0.8)
        assert fused[names[0]] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_side_view_counts_fully_between_families(spark):
    for other, share in (("square_pyramid", 0.5), ("octagonal_prism", 0.175)):
        fused = adaptive(spark, ("square_prism", other), 0.6, 0.1)
        odds = (1 - share) * math.log(1.5) + share * math.log(1 / 9)
        assert fused["square_prism"] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_temperature_is_inside_the_grid(spark):
    rows = [("cube", 0.7, 0.3), ("prism", 0.2, 0.8), ("cube", 0.6, 0.4), ("prism", 0.35, 0.65)]
    df = spark.createDataFrame(rows, "y string, a double, b double").select("y", F.create_map(F.lit("cube"), F.col("a"), F.lit("prism"), F.col("b")).alias("s"))
    got = calibrate.fit_temperature(df, "s", "y").first()
    assert got["samples"] == 4 and 0.2 <= got["temperature"] <= 5.0


def test_policy_prefers_no_wrong_accepts_to_coverage(spark):
    # The side view is right where the top view is unsure; one row has both views wrong.
    rows = [(i, "a" if i % 3 else "b", 0.52 if i else 0.1, 0.9 if i else 0.2) for i in range(15)]
    df = spark.createDataFrame(rows, "id int, label string, t double, s double")

    def views(p):
        other = F.when(F.col("label") == "a", "b").otherwise("a")
        return F.map_from_arrays(F.array("label", other), F.array(F.col(p), 1 - F.col(p)))

    df = df.select("id", "label", views("t").alias("top"), views("s").alias("side"), F.lit(1.0).alias("quality"), F.lit(0.0).alias("topology"))
    rules = [{"method": m, "side_weight": w} for m in ("probability_sum", "log_product") for w in (0.1, 0.6)]
    got = calibrate.fit_policy(df, rules).first()
    assert got["wrong_accepts"] <= 1 and got["coverage"] >= 14 / 15 - 1e-9 or got["wrong_accepts"] == 0


def test_composition_merges_repeats(spark):
    df = spark.createDataFrame([(1, "三棱柱:2，square_pyramid=1;三棱柱")], "k int, text string")
    assert {(r["label"], r["count"]) for r in labels.composition_counts(df, ["k"], "text").collect()} == {("三棱柱", 3), ("square_pyramid", 1)}


def test_reading_a_registry_twice_gives_one_owner(spark):
    registry = labels.registry_frame(spark, [("a", "A", "x", ["one", "One"], True), ("b", "B", "x", ["ONE"], True)])
    assert [r["alias_key"] for r in labels.alias_conflicts(registry).collect()] == ["one"]


GATE_SCHEMA = """split string, scene_id string, true_label string, mono_label string, fused_label string, fused_accepted boolean,
 deployment_target string, human_reviewed boolean, platform_id string, mono_accepted boolean, safety_state_upgraded boolean,
 projection_error_px double, pair_delta_ms double, latency_ms double, side_occluded boolean, association_error boolean, missed_object boolean"""


def gate_table(spark, **worse):
    """Three classes of which the single view misses every tenth row; `worse` spoils one column of some rows."""
    rows = []
    for split, n in (("final_holdout", 90), ("development", 45), ("final_acceptance", 36)):
        for i in range(n):
            truth = ("cone", "cube", "ball")[i % 3]
            missed = split == "final_holdout" and i % 10 == 0
            row = {
                "split": split, "scene_id": f"{split}-{i}", "true_label": truth, "mono_label": "tray" if missed else truth,
                "fused_label": truth, "fused_accepted": True, "deployment_target": ("n100", "orin_nano")[i % 2], "human_reviewed": True,
                "platform_id": "competition", "mono_accepted": True, "safety_state_upgraded": False, "projection_error_px": 1.0 + i % 2,
                "pair_delta_ms": 5.0 + i % 7, "latency_ms": 100.0 + i, "side_occluded": False, "association_error": False, "missed_object": False,
            }
            rows.append(row | {k: f(i, row) for k, f in worse.items()})
    names = [f.strip().split()[0] for f in GATE_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], GATE_SCHEMA)


@pytest.mark.parametrize(
    "worse, promoted",
    [
        ({}, True),
        ({"latency_ms": lambda i, r: 60_000.0}, False),
        ({"deployment_target": lambda i, r: "n100"}, False),
        ({"safety_state_upgraded": lambda i, r: i == 1}, False),
        ({"fused_label": lambda i, r: r["mono_label"]}, False),
    ],
)
def test_each_gate_alone_stops_a_promotion(spark, worse, promoted):
    got = evaluation.promotion_gates(gate_table(spark, **worse)).first().asDict()
    assert got["promote"] is promoted, {k: v for k, v in got.items() if k.startswith("gate")}
    if promoted:
        assert got["macro_recall_gain"] == pytest.approx(0.1)


def test_collection_targets_without_colours(spark):
    registry = labels.registry_frame(spark, [("cube", "Cube", "prism", [], True)])
    rows = [("cube", split, "red", f"i{split[0]}{k % 2}") for split, n in (("train", 50), ("probability_calibration", 15), ("final_holdout", 15)) for k in range(n)]
    got = audits.collection_targets(spark.createDataFrame(rows, "label_id string, split string, color_id string, instance_id string"), registry).first()
    assert got["counts_ok"] and not got["colours_ok"] and not got["ready"]


def test_annotation_states(spark):
    d = spark.createDataFrame([("f", "o", [1, 2, 3, 4])], "frame_id string, object_id string, bbox_px array<int>")
    for reviewed, box, expected in ((False, [1, 2, 3, 4], "not_confirmed"), (True, [1, 2, 3, 4], "accepted"), (True, [0, 2, 3, 4], "bbox_changed")):
        notes = spark.createDataFrame([("f", "o", reviewed, "cube", box)], "frame_id string, object_id string, reviewed boolean, label_id string, bbox_px array<int>")
        assert joins.confirmed_assignments(d, notes, ["cube"]).first()["reason"] == expected


def test_two_objects_in_one_view_hide_each_other(spark):
    df = spark.createDataFrame([("f", "a", 10.0, 10.0, 40.0, 40.0), ("f", "b", 12.0, 10.0, 40.0, 40.0)], "f string, id string, x double, y double, w double, h double")
    assert all(r["overlap"] > 0.30 for r in max_overlap(df, ["f"]).collect())


def test_clearance_far_near_and_alone(spark):
    rows = [("f", "a", 0.0, 0.0, 10.0, 10.0), ("f", "b", 1500.0, 900.0, 10.0, 10.0), ("f", "c", 1500.0, 915.0, 3.0, 3.0), ("g", "d", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "f string, id string, x double, y double, w double, h double")
    got = {r["id"]: r["clearance"] for r in nearest_gap(df, ["f"]).collect()}
    assert got["a"] == pytest.approx((1490**2 + 890**2) ** 0.5) and got["b"] == got["c"] == 5.0 and got["d"] is None


def test_population_hash_is_one_tree_at_every_size(spark):
    import hashlib
    import json

    def digest(values):
        return hashlib.sha256(json.dumps(values, separators=(",", ":")).encode()).hexdigest()

    def tree(ids):
        level = {}
        for i in sorted(ids):
            level.setdefault(hashlib.sha256(i.encode()).hexdigest()[:2], []).append(i)
        return digest([{"leaf": k, "h": digest(v)} for k, v in sorted(level.items())])

    for n in (1, 900):
        df = spark.range(n).select(F.col("id").cast("string").alias("id"))
        got = audits.population_hash(df.repartition(3), "id", digits=2).first()[0]
        assert got == tree([str(i) for i in range(n)])
    assert got != audits.population_hash(df.filter("id <> '5'"), "id", digits=2).first()[0]


def test_clearance_beyond_any_fixed_cell(spark):
    df = spark.createDataFrame([("f", "a", 0.0, 0.0, 5.0, 5.0), ("f", "b", 9000.0, 0.0, 5.0, 5.0)], "f string, id string, x double, y double, w double, h double")
    assert [r["clearance"] for r in nearest_gap(df, ["f"]).collect()] == [8995.0, 8995.0]


def test_few_points_have_all_trials(spark):
    from framelake.operators.points import fit_plane_ransac

    flat = [(1, i, float(i % 3), float(i // 3), 7.0) for i in range(6)] + [(1, 9, 1.0, 1.0, 90.0)]
    df = spark.createDataFrame(flat + [(2, 1, 0.0, 0.0, 1.0)], "k int, i int, x double, y double, z double")
    got = {r["k"]: r for r in fit_plane_ransac(df, ["k"], "i", threshold=0.5, iterations=40).collect()}
    assert got[1]["points"] == 6 and abs(got[1]["nz"]) == pytest.approx(1.0) and 2 not in got


def test_no_previous_frame_counts_as_moving(spark):
    assert one(spark, N.at_most_or_unbounded(F.lit(None).cast("double"), 2.5)) is False
    assert one(spark, N.at_least_or_unbounded(F.lit(None).cast("double"), 8.0)) is True
