"""Selection within frames and rules over consecutive frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.numeric import clip, thumbnail_motion
from framelake.plans.scan import ordinal, running


def primary_object(df: DataFrame, sample: str, size: str, item: str, values: Sequence[str]) -> DataFrame:
    """The object with most pixels of each sample; equal sizes go to the smaller id."""
    best = df.groupBy(sample).agg(
        F.min_by(F.struct(item, *values), F.when(F.col(item).isNotNull(), F.struct(-F.col(size), F.col(item)))).alias("o")
    )
    return best.select(sample, "o.*")


def selection_score(confidence: Column, clearance: Column, *, weight: float = 0.25, min_clearance: float = 10.0) -> Column:
    """Confidence with a share for free space; no neighbour counts as most free."""
    free = clip(F.coalesce(clearance / max(1.0, 4.0 * min_clearance), F.lit(1.0)), 0.0, 1.0)
    return (1.0 - weight) * confidence + weight * free


def select_target(df: DataFrame, keys: Sequence[str], item: str, score: str, status: str = "status") -> DataFrame:
    """Marks at most one object per frame: the pickable one with the best score, then the smaller id."""
    keys = list(keys)
    can = F.col(status) == "PICKABLE"
    best = df.filter(can).groupBy(*keys).agg(F.min_by(item, F.struct(-F.col(score), F.col(item))).alias("__best"))
    return df.join(best, keys, "left").withColumn(
        "selected", F.coalesce(can & (F.col(item) == F.col("__best")), F.lit(False))
    ).drop("__best")


def better_pass(first: DataFrame, second: DataFrame, keys: Sequence[str], score: str = "confidence") -> DataFrame:
    """Results of the second pass where the first selected nothing and the second did better."""
    keys = list(keys)
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    best = both.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when((F.col("pass") == p) & F.col("selected"), F.col(score))), F.lit(-1.0)).alias(f"__b{p}")
            for p in (1, 2)
        ]
    )
    use = F.when((F.col("__b1") < 0) & (F.col("__b2") > F.col("__b1")), 2).otherwise(1)
    return both.join(best.select(*keys, use.alias("__use")), keys).filter(F.col("pass") == F.col("__use")).drop("__use")


def runs(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], state: Column, continues: Column) -> DataFrame:
    """Adds ``run_length``: rows since the last row that did not continue its predecessor, itself included.

    ``state`` is what a row shows its successor; ``continues`` compares it with ``prev`` (null at the start).
    Both steps are bucketed scans, so a long session is spread over tasks.
    """
    shown = df.withColumn("__state", state)
    with_prev = running(
        shown, keys, bucket, order, {"__pos": ("sum", F.lit(1)), "prev": ("last", F.col("__state"))}, exclusive=True
    )
    starts = F.when(~F.coalesce(continues, F.lit(False)), F.col("__pos"))
    marked = with_prev.withColumn("__start", starts)
    placed = running(marked, keys, bucket, order, {"__from": ("max", F.col("__start"))})
    return placed.withColumn("run_length", F.col("__pos") - F.col("__from") + 1).drop(
        "__state", "__pos", "__start", "__from"
    )


def temporal_stability(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], *, frames: int = 2, max_move: float = 3.0
) -> DataFrame:
    """Deselects a target not seen at the same place with the same class in enough consecutive frames.

    One row per frame with selected, class_key, x and y; a frame without selection resets.
    """
    state = F.struct(F.col("selected").alias("s"), F.col("class_key").alias("c"), F.col("x").alias("x"), F.col("y").alias("y"))
    same = (
        F.col("selected") & F.col("prev.s") & (F.col("prev.c") == F.col("class_key"))
        & (F.hypot(F.col("prev.x") - F.col("x"), F.col("prev.y") - F.col("y")) <= max_move)
    )
    counted = runs(df, keys, bucket, order, state, same)
    stable = F.when(F.col("selected"), F.col("run_length")).otherwise(F.lit(0))
    return counted.withColumn("stable_count", stable).withColumn(
        "stable_selected", F.col("selected") & (F.col("stable_count") >= max(1, frames))
    ).drop("run_length", "prev")


def quality_streak(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], picture: str, *, required: int = 3, max_motion: float = 2.5
) -> DataFrame:
    """Motion against the previous frame, consecutive calm frames and readiness; the first frame has no motion.

    ``picture`` is an array column, the frame's thumbnail; motion is the mean absolute difference of its cells, so a frame
    of equal mean whose content has moved is not calm.
    """
    state = F.struct(F.col(picture).alias("m"))
    motion = thumbnail_motion(F.col(picture), F.col("prev.m"))
    counted = runs(df, keys, bucket, order, state, motion <= max_motion)
    return counted.withColumn("motion", motion).withColumn("stable_frames", F.col("run_length") - 1).withColumn(
        "ready", F.col("stable_frames") >= required
    ).drop("prev", "run_length")


def next_scene(counts: DataFrame, keys: Sequence[str], *, target: int, requested: int = 0, scene: str = "scene_index", count: str = "captures") -> DataFrame:
    """Scene to record next per key, which repeat it is, and whether its layout is new."""
    if requested < 0:
        raise ValueError("scene_index must not be negative")
    latest = counts.groupBy(*keys).agg(
        F.max(F.struct(scene, count)).alias("__l"),
        F.max(F.when(F.col(scene) == requested, F.col(count))).alias("__r"),
    )
    if requested:
        index, repeat = F.lit(requested).cast("bigint"), F.coalesce("__r", F.lit(0)) + 1
    else:
        stay = F.col(f"__l.{count}") < target
        index = F.when(stay, F.col(f"__l.{scene}")).otherwise(F.col(f"__l.{scene}") + 1).cast("bigint")
        repeat = F.when(stay, F.col(f"__l.{count}") + 1).otherwise(F.lit(1))
    out = latest.select(*keys, index.alias("next_scene"), repeat.alias("repeat_index"))
    return out.withColumn("independent_layout", F.col("repeat_index") == 1)


def next_incomplete_label(labels: DataFrame, counts: DataFrame, keys: Sequence[str], *, current: str, target: int) -> DataFrame:
    """Cyclically next label below target after the current one (labels: keys, label, idx, n, current)."""
    joined = labels.join(counts, [*keys, "label"], "left")
    below = F.coalesce("captures", F.lit(0)) < target
    step = F.pmod(F.col("idx") - F.col(current) - 1, F.col("n"))
    return joined.groupBy(*keys).agg(F.min_by("label", F.when(below, step)).alias("next_label"))


def assign_by_rank(
    df: DataFrame, frame: str, mapping: DataFrame, *, ambiguous: DataFrame | None = None, group: str = "hue_group", area: str = "area", item: str = "object_id"
) -> DataFrame:
    """Labels from (hue group, rank by area); a frame with a wrong group size or on the list has a reason.

    mapping: group, rank, label. Groups of a wrong size leave before the ranks are made, so ranked groups
    are as small as the mapping.
    """
    wanted = mapping.groupBy(group).agg(F.count(F.lit(1)).alias("__want"))
    groups = wanted.count()
    sizes = df.groupBy(frame, group).agg(F.count(F.lit(1)).alias("__have")).join(wanted, group, "left")
    frames = sizes.groupBy(frame).agg(
        (F.bool_and(F.coalesce(F.col("__have") == F.col("__want"), F.lit(False))) & (F.count(F.lit(1)) == groups)).alias("__ok")
    )
    if ambiguous is not None:
        frames = frames.join(ambiguous.select(frame, F.lit(True).alias("__listed")), frame, "left")
    else:
        frames = frames.withColumn("__listed", F.lit(False))
    reason = (
        F.when(F.coalesce("__listed", F.lit(False)), "instance_labels_need_review")
        .when(~F.col("__ok"), "wrong_group_sizes")
        .otherwise("accepted")
    )
    marked = df.join(frames.select(frame, reason.alias("reason")), frame)
    good = marked.filter("reason = 'accepted'")
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy(frame, group).orderBy(area, item)))
    labelled = ranked.join(mapping, [group, "rank"], "left").select(frame, item, "label", "reason")
    return labelled.unionByName(
        marked.filter("reason <> 'accepted'").select(frame, item, F.lit(None).cast("string").alias("label"), "reason")
    )


def sample_every(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], *, fps: float, interval_ms: float) -> DataFrame:
    """Every n-th frame of a recording, n from the frame rate and the wanted interval (at least 2)."""
    stride = max(2, round(fps * interval_ms / 1000.0))
    placed = ordinal(df, keys, bucket, order, "__o")
    return placed.filter((F.col("__o") - 1) % stride == 0).drop("__o")


def first_per_interval(df: DataFrame, keys: Sequence[str], *, interval_ns: int, item: str) -> DataFrame:
    """First frame of each interval of a session."""
    slot = F.expr(f"ns div {int(interval_ns)}")
    rest = [c for c in df.columns if c not in keys]
    first = df.withColumn("__slot", slot).groupBy(*keys, "__slot").agg(F.min_by(F.struct(*rest), F.struct("ns", item)).alias("r"))
    return first.select(*keys, "r.*")


def reading_order(df: DataFrame, keys: Sequence[str], item: str, *, band: float = 32.0) -> DataFrame:
    """Position of each object of a frame, top to bottom, then left to right."""
    banded = df.withColumn("__b", F.floor(F.col("y") / band))
    return ordinal(banded, keys, "__b", ["y", "x", item], "position").drop("__b")


def worst_first(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_candidate(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The winning candidate by a chain of criteria (smaller is better), one row per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, "b.*")


def review_focus(df: DataFrame, item: str, richness: Sequence[str], *, richest: int = 8, poorest: int = 2) -> DataFrame:
    """The richest rows and the poorest ones, each row once."""
    top = df.orderBy(*[F.desc(c) for c in richness], item).limit(richest)
    low = df.orderBy(*[F.asc(c) for c in richness], F.desc(item)).limit(poorest)
    return top.unionByName(low).dropDuplicates([item])
