"""Set operations over samples, keys, registries and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.plans.boxes import with_cells


def union_roots(*roots: DataFrame) -> DataFrame:
    """All samples of several roots with the number of their root."""
    out = None
    for order, root in enumerate(roots):
        part = root.withColumn("root_order", F.lit(order))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def key_difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys on only one side, with the side."""
    left = first.select(key).exceptAll(second.select(key)).withColumn("side", F.lit("first"))
    right = second.select(key).exceptAll(first.select(key)).withColumn("side", F.lit("second"))
    return left.unionByName(right)


def key_intersection(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.select(key).intersect(second.select(key))


def observed_registry(registry: DataFrame, observed: DataFrame, label: str = "label_id") -> DataFrame:
    """Registry classes with whether any sample carries them."""
    seen = observed.select(F.col(label).alias("class_id"), F.lit(True).alias("__seen")).distinct()
    return registry.join(seen, "class_id", "left").withColumn("observed", F.coalesce("__seen", F.lit(False))).drop("__seen")


def candidate_union(verified: DataFrame, legacy: DataFrame, keys: Sequence[str], *, distance: float = 3.0, min_length: float = 4.0) -> DataFrame:
    """Verified segments and the legacy ones that lie on none of them, the latter flagged unverified.

    Two segments coincide when their end points, taken in either direction, are together within the
    distance; then the first ends are within it too, which the cell join uses.
    """
    keys, ends = list(keys), ["x1", "y1", "x2", "y2"]
    long = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= min_length
    usable = legacy.filter(long)
    flips = F.array(
        F.struct(*[F.col(c).alias(f"v_{c}") for c in ends]),
        F.struct(*[F.col(c).alias(f"v_{d}") for c, d in zip(("x2", "y2", "x1", "y1"), ends)]),
    )
    marks = with_cells(
        verified.select(*keys, F.explode(flips).alias("e")).select(*keys, "e.*"),
        (F.col("v_x1"), F.col("v_y1")), (F.col("v_x1"), F.col("v_y1")), distance, grow=distance,
    )
    placed = usable.withColumn("cu", F.floor(F.col("x1") / distance)).withColumn("cv", F.floor(F.col("y1") / distance))
    gap = F.sqrt(sum((((F.col(c) - F.col(f"v_{c}")) ** 2) for c in ends[1:]), (F.col("x1") - F.col("v_x1")) ** 2))
    condition = gap <= distance
    for k in [*keys, "cu", "cv"]:
        condition = condition & (placed[k] == marks[k])
    fresh = placed.join(marks, condition, "left_anti").drop("cu", "cv")
    return verified.withColumn("image_verified", F.lit(True)).unionByName(fresh.withColumn("image_verified", F.lit(False)))


def pending_labels(detections: DataFrame, annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects without a reviewed annotation, with an empty label to fill in."""
    done = annotations.filter("reviewed").select(*keys)
    return detections.join(done, list(keys), "left_anti").withColumns(
        {"label_id": F.lit(None).cast("string"), "reviewed": F.lit(False)}
    )
