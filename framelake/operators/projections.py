"""Row-wise gates, states and reasons (no shuffle; filters reach the scan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import labels, numeric

# States of a detection.
PICKABLE, UNCERTAIN, OCCLUDED = "PICKABLE", "UNCERTAIN", "OCCLUDED"
DEPTH_INVALID, NO_GRASP_SURFACE, DEPTH_REQUIRED = "DEPTH_INVALID", "NO_GRASP_SURFACE", "DEPTH_REQUIRED"
STATUSES = (PICKABLE, UNCERTAIN, OCCLUDED, DEPTH_INVALID, NO_GRASP_SURFACE, DEPTH_REQUIRED)


def validated_ids(df: DataFrame, column: str) -> DataFrame:
    """Adds the trimmed id and whether it is valid."""
    return df.withColumn("clean_id", F.trim(column)).withColumn("id_ok", labels.valid_id(F.col(column)))


def resolve_labels(
    df: DataFrame, column: str, aliases: DataFrame, *, require_enabled: bool = True
) -> DataFrame:
    """Adds ``class_id`` and ``label_reason`` (ok, unknown_label, disabled_label)."""
    lookup = aliases.select("alias_key", F.col("class_id").alias("__id"), F.col("enabled").alias("__on"))
    joined = df.withColumn("alias_key", labels.alias_key(F.col(column))).join(lookup, "alias_key", "left")
    off = F.lit(require_enabled) & ~F.coalesce(F.col("__on"), F.lit(True))
    reason = F.when(F.col("__id").isNull(), "unknown_label").when(off, "disabled_label").otherwise("ok")
    return (
        joined.withColumn("label_reason", reason)
        .withColumn("class_id", F.when(F.col("label_reason") == "ok", F.col("__id")))
        .drop("__id", "__on")
    )


def eligible(df: DataFrame, split: str) -> DataFrame:
    """Human-reviewed rows of one split."""
    return df.filter((F.col("split") == split) & F.col("human_reviewed"))


def select_batches(df: DataFrame, batch_ids: Sequence) -> DataFrame:
    return df.filter(F.col("batch_id").isin(list(batch_ids)))


def detection_status(
    *,
    valid_depth_ratio: Column,
    touches_border: Column,
    clearance: Column,
    colour_known: Column,
    shape_known: Column,
    ambiguous: Column,
    colour_confidence: Column,
    shape_confidence: Column,
    grasp_score: Column,
    min_depth: float = 0.85,
    min_clearance: float = 8.0,
    min_colour: float = 0.72,
    min_shape: float = 0.68,
    min_grasp: float = 0.72,
) -> Column:
    """Ordered gates of a depth detection; a null clearance means no neighbour."""
    free = numeric.at_least_or_unbounded(clearance, min_clearance)
    doubtful = (
        ~colour_known | ambiguous | ~shape_known
        | (colour_confidence < min_colour) | (shape_confidence < min_shape)
    )
    return (
        F.when(valid_depth_ratio < min_depth, DEPTH_INVALID)
        .when(touches_border | ~free, OCCLUDED)
        .when(doubtful, UNCERTAIN)
        .when(grasp_score.isNull() | (grasp_score < min_grasp), NO_GRASP_SURFACE)
        .otherwise(PICKABLE)
    )


def detection_status_2d(
    *,
    touches_border: Column,
    clearance: Column,
    colour_known: Column,
    shape_known: Column,
    colour_confidence: Column,
    shape_confidence: Column,
    combined: Column,
    min_clearance: float = 10.0,
    min_colour: float = 0.72,
    min_shape: float = 0.68,
    min_pick: float = 0.72,
) -> Column:
    free = numeric.at_least_or_unbounded(clearance, min_clearance)
    doubtful = (
        ~colour_known | ~shape_known
        | (colour_confidence < min_colour) | (shape_confidence < min_shape) | (combined < min_pick)
    )
    return F.when(touches_border | ~free, OCCLUDED).when(doubtful, UNCERTAIN).otherwise(PICKABLE)


def upgrade_allowed(
    *,
    status: Column,
    top_reason: Column,
    valid_depth_ratio: Column,
    ambiguous: Column,
    touches_border: Column,
    clearance: Column,
    colour_known: Column,
    colour_confidence: Column,
    grasp_score: Column,
    min_depth: float = 0.85,
    min_clearance: float = 8.0,
    min_colour: float = 0.72,
    min_grasp: float = 0.72,
) -> Column:
    """Whether side evidence may raise an uncertain object: everything but the shape margin is fine."""
    return numeric.truth(
        (status == UNCERTAIN)
        & (top_reason == "margin_rejected")
        & (valid_depth_ratio >= min_depth)
        & ~ambiguous
        & ~touches_border
        & numeric.at_least_or_unbounded(clearance, min_clearance)
        & colour_known
        & (colour_confidence >= min_colour)
        & (grasp_score >= min_grasp)
    )


def frame_health(
    *,
    tray_ratio: Column,
    plane_shift: Column,
    sync_ms: Column,
    min_ratio: float = 0.5,
    max_shift: float = 3.0,
    max_sync: float = 20.0,
) -> Column:
    """First reason a frame is unusable, or ``ok``."""
    return numeric.first_reason(
        ("insufficient_tray_depth", tray_ratio < min_ratio),
        ("tray_plane_not_visible", plane_shift.isNull() | F.isnan(plane_shift)),
        ("tray_plane_shift_exceeded", F.abs(plane_shift) > max_shift),
        ("rgb_depth_out_of_sync", sync_ms > max_sync),
    )


def service_health(
    *,
    source_error: Column,
    run_state: Column,
    interlock_reason: Column,
    interlock_status: Column,
    mode: Column,
    pipeline_ok: Column,
    pipeline_reason: Column,
) -> Column:
    """Struct of ok, can_compute, can_pick and reason of the running service."""
    failed, ready = source_error.isNotNull(), run_state == "READY"
    ok = F.when(failed, F.lit(False)).when(ready, F.coalesce(pipeline_ok, F.lit(True))).otherwise(
        interlock_status != "MOTION_UNSTABLE"
    )
    reason = (
        F.when(failed, "camera_error")
        .when(~ready, interlock_reason)
        .when(mode == "RGB_ONLY", "depth_required")
        .otherwise(F.coalesce(pipeline_reason, F.lit("ready")))
    )
    can_pick = ready & ~failed & mode.isin("RGBD", "RGBD_DUAL") & F.coalesce(pipeline_ok, F.lit(False))
    return F.struct(
        ok.alias("ok"), (ready & ~failed).alias("can_compute"), can_pick.alias("can_pick"), reason.alias("reason")
    )


def close_relative(actual: Column, expected: Column, tolerance: float) -> Column:
    return F.abs(actual - expected) <= 1e-8 + tolerance * F.abs(expected)


def close_absolute(actual: Column, expected: Column, tolerance: float) -> Column:
    return F.abs(actual - expected) <= tolerance + 1e-5 * F.abs(expected)


def intrinsics_match(actual: dict[str, Column], expected: dict[str, Column]) -> Column:
    """fx, fy within 2 %, cx, cy within 3 px."""
    return (
        close_relative(actual["fx"], expected["fx"], 0.02)
        & close_relative(actual["fy"], expected["fy"], 0.02)
        & close_absolute(actual["cx"], expected["cx"], 3.0)
        & close_absolute(actual["cy"], expected["cy"], 3.0)
    )


def plane_moved(
    normal: Sequence[Column], offset: Column, other: Sequence[Column], other_offset: Column,
    max_angle: float = 3.0, max_shift: float = 3.0,
) -> Column:
    """Whether the tray plane differs from the calibrated one by angle or distance."""
    dot = sum((a * b for a, b in zip(normal[1:], other[1:])), normal[0] * other[0])
    angle = F.degrees(F.acos(numeric.clip(dot, -1.0, 1.0)))
    shift = F.abs(-offset * dot + other_offset)
    return (angle > max_angle) | (shift > max_shift)


def fusion_base_state(
    *,
    calibration_valid: Column,
    side_present: Column,
    synchronized: Column,
    sizes_match: Column,
    intrinsics_ok: Column,
    platform_ok: Column,
    plane_ok: Column,
) -> Column:
    """State that sends a whole frame to the single-view path, or null."""
    return (
        F.when(~numeric.truth(calibration_valid), "CALIBRATION_INVALID")
        .when(~numeric.truth(side_present), "SIDE_MISSING")
        .when(~numeric.truth(synchronized), "UNSYNCED")
        .when(~numeric.truth(sizes_match & intrinsics_ok & platform_ok & plane_ok), "CALIBRATION_INVALID")
    )


def capture_rejections(
    *,
    stable_frames: Column,
    valid_ratio: Column,
    sync_ms: Column,
    required_stable: int = 3,
    min_valid: float = 0.85,
    max_sync: float = 50.0,
) -> Column:
    """All failed gates of a single-camera capture, in order."""
    return numeric.reasons(
        ("camera_or_object_moving", stable_frames < required_stable),
        ("depth_valid_ratio_low", valid_ratio < min_valid),
        ("rgb_depth_out_of_sync", F.coalesce(sync_ms > max_sync, F.lit(True))),
    )


def pair_capture_rejections(
    *,
    side_present: Column,
    synchronized: Column,
    primary_sync_ms: Column,
    valid_ratio: Column,
    stable_frames: Column,
    side_blur: Column,
    max_sync: float = 20.0,
    min_valid: float = 0.85,
    required_stable: int = 3,
    min_blur: float = 35.0,
) -> Column:
    """All failed gates of a two-camera capture, in order."""
    return numeric.reasons(
        ("side_camera_missing", ~side_present),
        ("camera_pair_out_of_sync", ~numeric.truth(synchronized)),
        ("primary_rgb_depth_out_of_sync", primary_sync_ms > max_sync),
        ("depth_valid_ratio_low", valid_ratio < min_valid),
        ("camera_or_object_moving", stable_frames < required_stable),
        ("side_image_blurred", F.coalesce(side_blur, F.lit(0.0)) < min_blur),
    )


def rgb_only_results(df: DataFrame) -> DataFrame:
    """2-D detections lifted to the depth record: no pose, never selected."""
    return df.withColumns(
        {
            "schema_version": F.lit(2),
            "status": F.lit(DEPTH_REQUIRED),
            "selected": F.lit(False),
            "pose_3d": F.lit(None).cast("struct<x:double,y:double,z:double>"),
            "grasp": F.lit(None).cast("struct<score:double>"),
        }
    )


# Strict limits of a two-camera calibration.
STRICT_LIMITS = {
    "primary_rms_px": 0.8,
    "side_rms_px": 0.8,
    "joint_projection_p95_px": 3.0,
    "scale_error_ratio": 0.01,
}


def calibration_gates(metrics: dict[str, Column], limits: dict[str, Column] | None = None) -> Column:
    """Map of gate name to verdict; without limits the strict ones apply."""
    used = limits or {k: F.lit(v) for k, v in STRICT_LIMITS.items()}
    parts: list[Column] = []
    for name in STRICT_LIMITS:
        parts += [F.lit(name), numeric.truth(metrics[name] <= used[name])]
    return F.create_map(*parts)


def all_gates(gates: Column) -> Column:
    return F.forall(F.map_values(gates), lambda v: v)


def scene_size_gate(
    count: Column, resolvable: Column, synchronized: Column, smallest: int = 5, largest: int = 8
) -> Column:
    return numeric.first_reason(
        ("object_count_out_of_range", ~count.between(smallest, largest)),
        ("unknown_label", ~resolvable),
        ("pair_not_synchronized", ~synchronized),
        ok="accepted",
    )


# Digits of the published numbers.
OUTPUT_DIGITS = {"position": 3, "quaternion": 6, "confidence": 4, "overlap": 5}


def output_rounding(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rounds columns by kind (position, quaternion, confidence, overlap), half to even."""
    return df.withColumns(
        {name: numeric.rounded(F.col(name), OUTPUT_DIGITS[kind]) for name, kind in kinds.items()}
    )
