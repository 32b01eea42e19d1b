"""Pairing frames of two cameras in time or by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.plans.scan import ordinal, running


def pair_frames(
    primary: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    *,
    tolerance_ms: float = 50.0,
    bucket_ns: int = 3_600_000_000_000,
) -> DataFrame:
    """Every primary frame with the side frame nearest in time (columns ns and frame_id on both sides).

    The earlier side frame wins a tie; without any side frame the side is null. A pair farther apart than
    the tolerance is kept and marked. Frames are scanned inside ``keys + time bucket``; the last side frame
    before and the first after a bucket come from a summary with one row per bucket, so a session of any
    length is split over tasks and an empty bucket costs nothing.
    """
    keys = list(keys)
    bucket = F.expr(f"ns div {int(bucket_ns)}")
    none = F.lit(None).cast(side.schema["frame_id"].dataType)
    stamp = F.struct(F.col("ns").alias("ns"), F.col("frame_id").alias("id"))
    a = primary.select(*keys, "ns", F.col("frame_id").alias("primary_id"), F.lit(1).alias("role"), bucket.alias("b"), F.when(F.lit(False), F.struct(F.col("ns").alias("ns"), none.alias("id"))).alias("s"))
    b = side.select(*keys, "ns", F.lit(None).cast(primary.schema["frame_id"].dataType).alias("primary_id"), F.lit(0).alias("role"), bucket.alias("b"), stamp.alias("s"))
    marks = a.unionByName(b)
    cells = [*keys, "b"]
    along = Window.partitionBy(*keys).orderBy("b")
    carried = (
        marks.groupBy(*cells)
        .agg(F.min("s").alias("first"), F.max("s").alias("last"))
        .select(
            *cells,
            F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
            F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
        )
    )
    inside = Window.partitionBy(*cells).orderBy("ns", "role")
    placed = marks.join(carried, cells).select(
        *keys, "ns", "primary_id", "role",
        F.coalesce(F.last("s", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "earlier").alias("before"),
        F.coalesce(F.first("s", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)), "later").alias("after"),
    )
    back, ahead = F.col("ns") - F.col("before.ns"), F.col("after.ns") - F.col("ns")
    use_before = F.col("after").isNull() | (back <= ahead)
    chosen = F.when(F.col("before").isNotNull() & use_before, F.col("before")).otherwise(F.col("after"))
    delta = F.abs(F.col("s.ns") - F.col("ns")) / 1e6
    return (
        placed.filter("role = 1")
        .withColumn("s", chosen)
        .select(
            *keys, F.col("primary_id"), F.col("ns").alias("primary_ns"), F.col("s.id").alias("side_id"),
            F.col("s.ns").alias("side_ns"), delta.alias("pair_delta_ms"),
            F.coalesce(delta <= tolerance_ms, F.lit(False)).alias("synchronized"),
        )
    )


def pair_one_to_one(
    primary: DataFrame, side: DataFrame, keys: Sequence[str], *, tolerance_ms: float = 50.0, bucket_ns: int = 3_600_000_000_000
) -> DataFrame:
    """Primary frames in order of time, each with the nearest side frame that lies behind the one used last.

    Side frames up to the used one are gone, so no side frame serves twice and none goes backward. If the nearest
    one is gone, the first one left is nearest, as all that are left are later. So with the k-th primary frame's
    nearest side frame at place n(k), the used place is the larger of n(k) and the last used one plus 1, which is
    k plus the running maximum of n - k: two bucketed scans, no walk through a session. A place past the last side
    frame is none. Equal times go in order of frame_id on both sides.
    """
    keys = list(keys)
    c = F.col
    bucket = lambda ns: F.expr(f"{ns} div {int(bucket_ns)}")
    placed = ordinal(side.select(*keys, "ns", "frame_id").withColumn("__b", bucket("ns")), keys, "__b", ["ns", "frame_id"], "__place")
    first = F.min("__place").over(Window.partitionBy(*keys, "ns"))
    marked = placed.select(*keys, "ns", F.struct(first.alias("__place"), "frame_id").alias("frame_id"))
    nearest = pair_frames(primary, marked, keys, bucket_ns=bucket_ns).select(
        *keys, "primary_id", "primary_ns", c("side_id.__place").alias("__nearest"), bucket("primary_ns").alias("__b")
    )
    order = ["primary_ns", "primary_id"]
    counted = ordinal(nearest, keys, "__b", order, "__k")
    used = running(counted, keys, "__b", order, {"__ahead": ("max", c("__nearest") - c("__k"))}).withColumn("__place", c("__k") + c("__ahead"))
    free = placed.select(*keys, "__place", c("frame_id").alias("side_id"), c("ns").alias("side_ns"))
    delta = F.abs(c("side_ns") - c("primary_ns")) / 1e6
    return used.join(free, [*keys, "__place"], "left").select(
        *keys, "primary_id", "primary_ns", "side_id", "side_ns", delta.alias("pair_delta_ms"),
        F.coalesce(delta <= tolerance_ms, F.lit(False)).alias("synchronized"),
    )


def stem(path: Column) -> Column:
    """File name without directory and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def pair_by_stem(primary: DataFrame, side: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Pairs files of two directories by stem; by position where no stem is shared and counts agree."""
    keys = list(keys)
    a = primary.select(*keys, stem(F.col(path)).alias("stem"), F.col(path).alias("primary_path"))
    b = side.select(*keys, stem(F.col(path)).alias("stem"), F.col(path).alias("side_path"))
    by_name = a.join(b, [*keys, "stem"])
    shared = by_name.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    equal = (
        a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"))
        .join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb")), keys)
        .filter("na = nb")
        .join(shared, keys, "left_anti")
        .select(*keys)
    )

    def placed(df: DataFrame, column: str) -> DataFrame:
        rest = df.join(equal, keys, "left_semi").withColumn("__b", F.substring("stem", 1, 8))
        return ordinal(rest, keys, "__b", ["stem", column], "position").drop("__b")

    by_place = placed(a, "primary_path").join(
        placed(b, "side_path").drop("stem"), [*keys, "position"]
    )
    columns = [*keys, "stem", "primary_path", "side_path"]
    return by_name.select(*columns).unionByName(by_place.select(*columns))


def session_pose_reasons(
    poses: DataFrame, reference: DataFrame, *, expected_tag: int, max_pair_ms: float = 50.0, max_sync_ms: float = 20.0
) -> DataFrame:
    """Reasons against each saved pose of a session; ``stale`` marks poses older than the reference."""
    from framelake.functions.numeric import reasons, truth

    ref = reference.select("session_id", F.col("ns").alias("__ref"))
    delta, sync = F.col("pair_delta_ms"), F.col("sync_ms")
    out_of_range = lambda c, top: truth(F.isnan(c) | (c < 0) | (c > top))
    return poses.join(ref, "session_id", "left").select(
        *[c for c in poses.columns],
        reasons(
            ("cameras_missing_or_unsynchronised", F.col("side_id").isNull() | out_of_range(delta, max_pair_ms)),
            ("primary_RGB_depth_sync_above_20_ms", out_of_range(sync, max_sync_ms)),
            ("different_free_tag", F.col("tag_id") != expected_tag),
        ).alias("reasons"),
        truth((F.col("__ref") > 0) & (F.col("ns") > 0) & (F.col("ns") < F.col("__ref"))).alias("stale"),
    )


def session_verdicts(poses: DataFrame, *, required: int) -> DataFrame:
    """Usable poses per session and whether they suffice."""
    usable = (F.size("reasons") == 0) & ~F.col("stale")
    return poses.groupBy("session_id").agg(
        F.count_if(usable).alias("usable_poses"),
        F.count_if(F.col("stale")).alias("stale_poses"),
        (F.count_if(usable) >= required).alias("enough"),
    )
