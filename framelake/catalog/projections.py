"""PRJ1-PRJ17."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.catalog.base import query
from framelake.catalog.views import captures, detections, frames, table
from framelake.functions import geometry, labels, numeric
from framelake.operators import projections as P


@query(
    "prj1_validate_id",
    """SELECT p_partkey AS part, trim(p_name) AS clean_id,
    regexp_full_match(trim(p_name), '[A-Za-z0-9_-]+') AS id_ok,
    regexp_full_match(trim(p_brand), '[A-Za-z0-9_-]+') AS brand_ok,
    regexp_full_match(trim(replace(p_name, ' ', '_')), '[A-Za-z0-9_-]+') AS joined_ok FROM part""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    return P.validated_ids(part, "p_name").select(
        F.col("p_partkey").alias("part"),
        "clean_id",
        "id_ok",
        labels.valid_id(F.col("p_brand")).alias("brand_ok"),
        labels.valid_id(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("joined_ok"),
    )


@query(
    "prj2_normalize_alias_key",
    """SELECT p_partkey AS part,
    regexp_replace(replace(lower(trim(p_name || ' - ' || p_type || '  ' || p_brand)), '-', '_'), '\\s+', '', 'g')
      AS alias_key FROM part""",
)
def _(spark, sf):
    text = F.concat("p_name", F.lit(" - "), "p_type", F.lit("  "), "p_brand")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), labels.alias_key(text).alias("alias_key")
    )


# Two words of the part names stand in for shape names.
PART_CLASSES = [
    ("gear", "Gear", "round", ["large gear", "Red-Gear", "hot gear", "old gear", "cold gear"], True),
    ("bolt", "Bolt", "rod", ["old bolt", "LARGE BOLT", "hot bolt"], True),
    ("ring", "Ring", "round", ["cold  ring", "hot ring"], False),
    ("plate", "Plate", "flat", ["small plate", "new plate", "blue plate"], True),
]
_ALIAS_SQL = """al(alias_key, class_id, enabled) AS (VALUES
 ('gear','gear',true),('largegear','gear',true),('red_gear','gear',true),('hotgear','gear',true),
 ('oldgear','gear',true),('coldgear','gear',true),
 ('bolt','bolt',true),('oldbolt','bolt',true),('largebolt','bolt',true),('hotbolt','bolt',true),
 ('ring','ring',false),('coldring','ring',false),('hotring','ring',false),
 ('plate','plate',true),('smallplate','plate',true),('newplate','plate',true),('blueplate','plate',true))"""


def part_aliases(spark):
    return labels.registry_aliases(labels.registry_frame(spark, PART_CLASSES))


@query(
    "prj3_resolve_label",
    f"""WITH {_ALIAS_SQL}
    SELECT p_partkey AS part, CASE WHEN enabled THEN class_id END AS class_id,
     CASE WHEN class_id IS NULL THEN 'unknown_label' WHEN NOT enabled THEN 'disabled_label' ELSE 'ok' END
       AS label_reason
    FROM part LEFT JOIN al
      ON al.alias_key = regexp_replace(replace(lower(trim(p_name)), '-', '_'), '\\s+', '', 'g')""",
)
def _(spark, sf):
    return P.resolve_labels(table(spark, sf, "part"), "p_name", part_aliases(spark)).select(
        F.col("p_partkey").alias("part"), "class_id", "label_reason"
    )


@query(
    "prj4_canonical_colour",
    """SELECT p_partkey AS part, raw_colour, CASE WHEN raw_colour = 'bule' THEN 'blue' ELSE raw_colour END AS colour
    FROM (SELECT p_partkey, replace(split_part(p_name, ' ', 1), 'blue', 'bule') AS raw_colour FROM part)""",
)
def _(spark, sf):
    raw = F.replace(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("blue"), F.lit("bule"))
    return (
        table(spark, sf, "part")
        .select(F.col("p_partkey").alias("part"), raw.alias("raw_colour"))
        .withColumn("colour", labels.canonical_colour(F.col("raw_colour")))
    )


REVIEWED_SQL = """rev AS (SELECT doc_id AS sample, source AS batch_id, lang AS label_id,
  CASE WHEN doc_id % 3 = 0 THEN 'final_holdout' WHEN doc_id % 3 = 1 THEN 'train' ELSE 'probability_calibration' END
   AS split, coalesce(quality = 1, false) AS human_reviewed, coalesce(toxic = 1, false) AS flagged
  FROM documents LEFT JOIN labels USING (doc_id))"""


def reviewed_captures(spark, sf):
    """Captures with a split and the outcome of their human review."""
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("sample"), "quality", "toxic")
    turn = F.col("sample") % 3
    return (
        captures(spark, sf)
        .select("sample", "batch_id", "label_id")
        .join(marks, "sample", "left")
        .select(
            "sample",
            "batch_id",
            "label_id",
            F.when(turn == 0, "final_holdout").when(turn == 1, "train").otherwise("probability_calibration")
            .alias("split"),
            numeric.truth(F.col("quality") == 1).alias("human_reviewed"),
            numeric.truth(F.col("toxic") == 1).alias("flagged"),
        )
    )


@query(
    "prj5_eligible",
    f"WITH {REVIEWED_SQL} SELECT sample, batch_id, label_id FROM rev WHERE split = 'final_holdout' AND human_reviewed",
)
def _(spark, sf):
    return P.eligible(reviewed_captures(spark, sf), "final_holdout").select("sample", "batch_id", "label_id")


@query(
    "prj6_select_batches",
    "SELECT sample, batch_id, label_id FROM docs WHERE batch_id IN ('src1', 'src3', 'src7')",
    "docs",
)
def _(spark, sf):
    return P.select_batches(captures(spark, sf), ["src1", "src3", "src7"]).select("sample", "batch_id", "label_id")


@query(
    "prj7_class_key",
    """SELECT object_id AS source_id, frame_id, truth || ':' || prediction AS class_key,
     truth || prediction AS display_name,
     frame_id || '-' || CASE WHEN length(CAST(line AS VARCHAR)) >= 2 THEN CAST(line AS VARCHAR)
       ELSE lpad(CAST(line AS VARCHAR), 2, '0') END AS object_id FROM det""",
    "det",
)
def _(spark, sf):
    return detections(spark, sf).select(
        F.col("object_id").alias("source_id"),
        "frame_id",
        labels.class_key(F.col("truth"), F.col("prediction")).alias("class_key"),
        labels.display_name(F.col("truth"), F.col("prediction")).alias("display_name"),
        labels.object_id(F.col("frame_id"), F.col("line")).alias("object_id"),
    )


# Safety inputs of a detection, spread over the columns of the stand-in.
SAFETY_SQL = """saf AS (SELECT frame_id, object_id, 1.0::DOUBLE - tax AS depth_ratio,
  x <= 4 OR y <= 4 OR x + w >= 636 OR y + h >= 476 AS border,
  CASE WHEN supp % 10 = 0 THEN NULL ELSE w END AS clearance, prediction <> 'R' AS colour_known,
  truth <> 'N' OR accepted AS shape_known, line = 7 AS ambiguous, confidence AS colour_confidence,
  1.0::DOUBLE - tax * 5 AS shape_confidence, CASE WHEN part % 13 = 0 THEN NULL ELSE price / 100000 END AS grasp,
  CASE WHEN truth = 'A' THEN 'accepted' WHEN truth = 'N' THEN 'margin_rejected' ELSE 'distance_rejected' END AS top_reason
  FROM det)"""


def safety(spark, sf):
    d = detections(spark, sf)
    return d.select(
        "frame_id",
        "object_id",
        (F.lit(1.0) - F.col("tax")).alias("depth_ratio"),
        geometry.touches_border(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 640, 480, 4).alias("border"),
        F.when(F.col("supp") % 10 != 0, F.col("w")).alias("clearance"),
        (F.col("prediction") != "R").alias("colour_known"),
        ((F.col("truth") != "N") | F.col("accepted")).alias("shape_known"),
        (F.col("line") == 7).alias("ambiguous"),
        F.col("confidence").alias("colour_confidence"),
        (F.lit(1.0) - F.col("tax") * 5).alias("shape_confidence"),
        F.when(F.col("part") % 13 != 0, F.col("price") / 100000).alias("grasp"),
        F.when(F.col("truth") == "A", "accepted").when(F.col("truth") == "N", "margin_rejected")
        .otherwise("distance_rejected").alias("top_reason"),
    )


def status_of(clearance="clearance"):
    c = F.col
    return P.detection_status(
        valid_depth_ratio=c("depth_ratio"), touches_border=c("border"), clearance=c(clearance),
        colour_known=c("colour_known"), shape_known=c("shape_known"), ambiguous=c("ambiguous"),
        colour_confidence=c("colour_confidence"), shape_confidence=c("shape_confidence"), grasp_score=c("grasp"),
        min_depth=0.93,
    )


STATUS_SQL = """CASE WHEN depth_ratio < 0.93 THEN 'DEPTH_INVALID'
  WHEN border OR coalesce(clearance < 8, false) THEN 'OCCLUDED'
  WHEN NOT colour_known OR ambiguous OR NOT shape_known OR colour_confidence < 0.72 OR shape_confidence < 0.68
    THEN 'UNCERTAIN'
  WHEN grasp IS NULL OR grasp < 0.72 THEN 'NO_GRASP_SURFACE' ELSE 'PICKABLE' END"""


@query(
    "prj8_detection_status",
    f"""WITH {SAFETY_SQL} SELECT frame_id, object_id, {STATUS_SQL} AS status,
     CASE WHEN border OR coalesce(clearance < 10, false) THEN 'OCCLUDED'
      WHEN NOT colour_known OR NOT shape_known OR colour_confidence < 0.72 OR shape_confidence < 0.68
        OR coalesce(grasp, 1.0) < 0.72 THEN 'UNCERTAIN' ELSE 'PICKABLE' END AS status_2d FROM saf""",
    "det",
)
def _(spark, sf):
    c = F.col
    flat = P.detection_status_2d(
        touches_border=c("border"), clearance=c("clearance"), colour_known=c("colour_known"),
        shape_known=c("shape_known"), colour_confidence=c("colour_confidence"),
        shape_confidence=c("shape_confidence"), combined=F.coalesce(c("grasp"), F.lit(1.0)),
    )
    return safety(spark, sf).select(
        "frame_id", "object_id", status_of().alias("status"), flat.alias("status_2d")
    )


@query(
    "prj9_upgrade_allowed",
    f"""WITH {SAFETY_SQL}, st AS (SELECT *, {STATUS_SQL} AS status FROM saf)
    SELECT frame_id, object_id, status, status = 'UNCERTAIN' AND top_reason = 'margin_rejected'
     AND depth_ratio >= 0.93 AND NOT ambiguous AND NOT border AND (clearance IS NULL OR clearance >= 8)
     AND colour_known AND colour_confidence >= 0.72 AND coalesce(grasp >= 0.72, false) AS upgrade FROM st""",
    "det",
)
def _(spark, sf):
    c = F.col
    return (
        safety(spark, sf)
        .withColumn("status", status_of())
        .select(
            "frame_id",
            "object_id",
            "status",
            P.upgrade_allowed(
                status=c("status"), top_reason=c("top_reason"), valid_depth_ratio=c("depth_ratio"),
                ambiguous=c("ambiguous"), touches_border=c("border"), clearance=c("clearance"),
                colour_known=c("colour_known"), colour_confidence=c("colour_confidence"),
                grasp_score=c("grasp"), min_depth=0.93,
            ).alias("upgrade"),
        )
    )


HEALTH_SQL = """hf AS (SELECT session_id, frame_id, kind, value, ns,
  CASE WHEN kind = 'error' THEN NULL ELSE value / 30 - 2 END AS shift,
  least(value / 60, 1.0::DOUBLE) AS tray, value / 3 AS sync FROM frames)"""


def health_frames(spark, sf):
    return frames(spark, sf).select(
        "session_id", "frame_id", "kind", "value", "ns",
        F.when(F.col("kind") != "error", F.col("value") / 30 - 2).alias("shift"),
        F.least(F.col("value") / 60, F.lit(1.0)).alias("tray"),
        (F.col("value") / 3).alias("sync"),
    )


def health_reason():
    return P.frame_health(tray_ratio=F.col("tray"), plane_shift=F.col("shift"), sync_ms=F.col("sync"))


HEALTH_CASE = """CASE WHEN tray < 0.5 THEN 'insufficient_tray_depth' WHEN shift IS NULL THEN 'tray_plane_not_visible'
  WHEN abs(shift) > 3 THEN 'tray_plane_shift_exceeded' WHEN sync > 20 THEN 'rgb_depth_out_of_sync' ELSE 'ok' END"""


@query(
    "prj10_frame_health",
    f"""WITH {HEALTH_SQL}, r AS (SELECT *, {HEALTH_CASE} AS reason FROM hf)
    SELECT frame_id, reason, reason = 'ok' AS ok FROM r""",
    "frames",
)
def _(spark, sf):
    return (
        health_frames(spark, sf).withColumn("reason", health_reason())
        .select("frame_id", "reason", (F.col("reason") == "ok").alias("ok"))
    )


@query(
    "prj11_service_health",
    f"""WITH {HEALTH_SQL}, r AS (SELECT *, {HEALTH_CASE} AS preason,
      CASE WHEN kind = 'error' THEN 'read failed' END AS err,
      CASE WHEN kind IN ('click', 'purchase', 'error') THEN 'READY' WHEN value > 90 THEN 'MOVING' ELSE 'SETTLING' END AS run_state,
      CASE WHEN frame_id % 7 = 0 THEN 'RGB_ONLY' WHEN frame_id % 2 = 0 THEN 'RGBD' ELSE 'RGBD_DUAL' END AS mode,
      CASE WHEN value > 120 THEN 'MOTION_UNSTABLE' ELSE 'OK' END AS ilock FROM hf)
    SELECT frame_id,
     CASE WHEN err IS NOT NULL THEN false WHEN run_state = 'READY' THEN preason = 'ok' ELSE ilock <> 'MOTION_UNSTABLE' END AS ok,
     run_state = 'READY' AND err IS NULL AS can_compute,
     run_state = 'READY' AND err IS NULL AND mode IN ('RGBD', 'RGBD_DUAL') AND preason = 'ok' AS can_pick,
     CASE WHEN err IS NOT NULL THEN 'camera_error' WHEN run_state <> 'READY' THEN lower(run_state)
      WHEN mode = 'RGB_ONLY' THEN 'depth_required' ELSE preason END AS reason FROM r""",
    "frames",
)
def _(spark, sf):
    c = F.col
    base = health_frames(spark, sf).select(
        "frame_id",
        health_reason().alias("preason"),
        F.when(c("kind") == "error", "read failed").alias("err"),
        F.when(c("kind").isin("click", "purchase", "error"), "READY").when(c("value") > 90, "MOVING")
        .otherwise("SETTLING").alias("run_state"),
        F.when(c("frame_id") % 7 == 0, "RGB_ONLY").when(c("frame_id") % 2 == 0, "RGBD")
        .otherwise("RGBD_DUAL").alias("mode"),
        F.when(c("value") > 120, "MOTION_UNSTABLE").otherwise("OK").alias("ilock"),
    )
    health = P.service_health(
        source_error=c("err"), run_state=c("run_state"), interlock_reason=F.lower("run_state"),
        interlock_status=c("ilock"), mode=c("mode"), pipeline_ok=c("preason") == "ok",
        pipeline_reason=c("preason"),
    )
    return base.withColumn("h", health).select("frame_id", "h.*")


@query(
    "prj12_fusion_base_state",
    """WITH cal AS (SELECT s_suppkey, s_nationkey, 600.0::DOUBLE AS fx, 600.0::DOUBLE AS fy, 320.0::DOUBLE AS cx,
       240.0::DOUBLE AS cy, s_acctbal > 0 AS valid FROM supplier),
     r AS (SELECT frame_id, object_id, d.w, d.h, valid, x, y, confidence, tax, price, s_nationkey,
       600 + (w - 25) AS afx, 600 + (h - 4) AS afy, 320 + (line - 4) AS acx, 240 + (line - 3) AS acy,
       2.0::DOUBLE * tax AS tilt FROM det d LEFT JOIN cal ON s_suppkey = supp)
    SELECT frame_id, object_id, CASE WHEN NOT coalesce(valid, false) THEN 'CALIBRATION_INVALID'
      WHEN confidence < 0.55 THEN 'SIDE_MISSING' WHEN price > 80000 THEN 'UNSYNCED'
      WHEN abs(afx - 600) > 1e-8 + 0.02 * 600 OR abs(afy - 600) > 1e-8 + 0.02 * 600
        OR abs(acx - 320) > 3 + 1e-5 * 320 OR abs(acy - 240) > 3 + 1e-5 * 240 THEN 'CALIBRATION_INVALID'
      WHEN s_nationkey = 3 THEN 'CALIBRATION_INVALID'
      WHEN degrees(acos(greatest(-1, least(1, cos(tilt))))) > 3
        OR abs(-500.0::DOUBLE * cos(tilt) + 501.0::DOUBLE) > 3 THEN 'CALIBRATION_INVALID' END AS state FROM r""",
    "det",
)
def _(spark, sf):
    c = F.col
    cal = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supp"), "s_nationkey", (F.col("s_acctbal") > 0).alias("valid")
    )
    tilt = c("tax") * 2.0
    moved = P.plane_moved(
        [F.lit(0.0), F.lit(0.0), F.lit(-1.0)], F.lit(500.0),
        [F.sin(tilt), F.lit(0.0), -F.cos(tilt)], F.lit(501.0),
    )
    actual = {"fx": c("w") + 575.0, "fy": c("h") + 596.0, "cx": c("line") + 316.0, "cy": c("line") + 237.0}
    expected = {"fx": F.lit(600.0), "fy": F.lit(600.0), "cx": F.lit(320.0), "cy": F.lit(240.0)}
    state = P.fusion_base_state(
        calibration_valid=c("valid"), side_present=c("confidence") >= 0.55, synchronized=c("price") <= 80000,
        sizes_match=F.lit(True), intrinsics_ok=P.intrinsics_match(actual, expected),
        platform_ok=c("s_nationkey") != 3, plane_ok=~moved,
    )
    return detections(spark, sf).join(cal, "supp", "left").select("frame_id", "object_id", state.alias("state"))


@query(
    "prj13_rejection_reasons",
    """SELECT frame_id, concat_ws(',', CASE WHEN v < 3 THEN 'camera_or_object_moving' END,
      CASE WHEN value / 60 < 0.85 THEN 'depth_valid_ratio_low' END,
      CASE WHEN coalesce(sync > 50, true) THEN 'rgb_depth_out_of_sync' END) AS reasons,
     concat_ws(',', CASE WHEN kind = 'signup' THEN 'side_camera_missing' END,
      CASE WHEN kind = 'error' THEN 'camera_pair_out_of_sync' END,
      CASE WHEN value / 3 > 20 THEN 'primary_rgb_depth_out_of_sync' END,
      CASE WHEN value / 60 < 0.85 THEN 'depth_valid_ratio_low' END,
      CASE WHEN v < 3 THEN 'camera_or_object_moving' END,
      CASE WHEN value * 2 < 35 THEN 'side_image_blurred' END) AS pair_reasons
    FROM (SELECT frame_id, kind, value, frame_id % 6 AS v, CASE WHEN kind = 'view' THEN NULL ELSE value END AS sync FROM frames)""",
    "frames",
)
def _(spark, sf):
    c = F.col
    base = frames(spark, sf).select(
        "frame_id", "kind", "value", (c("frame_id") % 6).alias("v"),
        F.when(c("kind") != "view", c("value")).alias("sync"),
    )
    single = P.capture_rejections(stable_frames=c("v"), valid_ratio=c("value") / 60, sync_ms=c("sync"))
    double = P.pair_capture_rejections(
        side_present=c("kind") != "signup", synchronized=c("kind") != "error", primary_sync_ms=c("value") / 3,
        valid_ratio=c("value") / 60, stable_frames=c("v"), side_blur=c("value") * 2,
    )
    return base.select(
        "frame_id",
        F.array_join(single, ",").alias("reasons"),
        F.array_join(double, ",").alias("pair_reasons"),
    )


@query(
    "prj14_rgb_only_results",
    """SELECT frame_id, object_id, 2 AS schema_version, 'DEPTH_REQUIRED' AS status, false AS selected,
     true AS no_pose, true AS no_grasp FROM det""",
    "det",
)
def _(spark, sf):
    return P.rgb_only_results(detections(spark, sf)).select(
        "frame_id", "object_id", "schema_version", "status", "selected",
        F.col("pose_3d").isNull().alias("no_pose"), F.col("grasp").isNull().alias("no_grasp"),
    )


@query(
    "prj15_calibration_gates",
    """WITH m AS (SELECT s_suppkey AS calibration, abs(s_acctbal) / 10000 AS a, (s_suppkey % 17) / 16.0::DOUBLE AS b,
       (s_suppkey % 29) / 7.0::DOUBLE AS c, (s_suppkey % 11) / 500.0::DOUBLE AS d FROM supplier)
     SELECT calibration, a <= 0.8 AS primary_ok, b <= 0.8 AS side_ok, c <= 3 AS projection_ok, d <= 0.01 AS scale_ok,
      a <= 0.8 AND b <= 0.8 AND c <= 3 AND d <= 0.01 AS strict_valid,
      a <= 0.9 AND b <= 0.9 AND c <= 4 AND d <= 0.015 AS relaxed_valid FROM m""",
)
def _(spark, sf):
    c = F.col
    base = table(spark, sf, "supplier").select(
        c("s_suppkey").alias("calibration"),
        (F.abs("s_acctbal") / 10000).alias("primary_rms_px"),
        ((c("s_suppkey") % 17) / F.lit(16.0)).alias("side_rms_px"),
        ((c("s_suppkey") % 29) / F.lit(7.0)).alias("joint_projection_p95_px"),
        ((c("s_suppkey") % 11) / F.lit(500.0)).alias("scale_error_ratio"),
    )
    metrics = {k: c(k) for k in P.STRICT_LIMITS}
    relaxed = dict(zip(P.STRICT_LIMITS, (F.lit(0.9), F.lit(0.9), F.lit(4.0), F.lit(0.015))))
    return base.withColumn("g", P.calibration_gates(metrics)).select(
        "calibration",
        c("g")["primary_rms_px"].alias("primary_ok"),
        c("g")["side_rms_px"].alias("side_ok"),
        c("g")["joint_projection_p95_px"].alias("projection_ok"),
        c("g")["scale_error_ratio"].alias("scale_ok"),
        P.all_gates(c("g")).alias("strict_valid"),
        P.all_gates(P.calibration_gates(metrics, relaxed)).alias("relaxed_valid"),
    )


@query(
    "prj16_scene_size_gate",
    """SELECT frame_id, count(*) AS objects, CASE WHEN count(*) NOT BETWEEN 5 AND 8 THEN 'object_count_out_of_range'
      WHEN NOT bool_and(part % 50 <> 0) THEN 'unknown_label' WHEN max(confidence) < 0.9 THEN 'pair_not_synchronized'
      ELSE 'accepted' END AS reason FROM det GROUP BY frame_id""",
    "det",
)
def _(spark, sf):
    scenes = detections(spark, sf).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("objects"),
        F.bool_and(F.col("part") % 50 != 0).alias("known"),
        F.max("confidence").alias("best"),
    )
    return scenes.select(
        "frame_id", "objects",
        P.scene_size_gate(F.col("objects"), F.col("known"), F.col("best") >= 0.9).alias("reason"),
    )


@query(
    "prj17_output_rounding",
    """SELECT frame_id, object_id, round_even(price / 7, 3) AS position, round_even(tax / 3, 6) AS quaternion,
     round_even(confidence / 3, 4) AS confidence, round_even(w / 64, 5) AS overlap FROM det""",
    "det",
)
def _(spark, sf):
    base = detections(spark, sf).select(
        "frame_id", "object_id", (F.col("price") / 7).alias("position"), (F.col("tax") / 3).alias("quaternion"),
        (F.col("confidence") / 3).alias("confidence"), (F.col("w") / 64).alias("overlap"),
    )
    return P.output_rounding(base, {k: k for k in ("position", "quaternion", "confidence", "overlap")})
