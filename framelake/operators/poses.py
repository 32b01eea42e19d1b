"""Selection of calibration views that differ from one another."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.plans.boxes import with_cells
from framelake.plans.greedy import greedy_keep


def similar_views(a: Column, b: Column, cameras: int, *, centre_px: float, log_area: float, angle_deg: float) -> Column:
    """Whether two signatures (centre x, y, log area, angle per camera) are alike in every camera."""
    out = F.lit(True)
    for camera in range(cameras):
        x, y, area, angle = ((a[4 * camera + i], b[4 * camera + i]) for i in range(4))
        turn = F.abs(F.atan2(F.sin(angle[0] - angle[1]), F.cos(angle[0] - angle[1])))
        out = out & (F.hypot(x[0] - x[1], y[0] - y[1]) < centre_px) & (F.abs(area[0] - area[1]) < log_area) & (
            turn < math.radians(angle_deg)
        )
    return out


def diverse_views(
    views: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    cameras: int = 1,
    centre_px: float = 28.0,
    log_area: float = 0.12,
    angle_deg: float = 10.0,
    block: int = 256,
) -> DataFrame:
    """Views in order of arrival that differ from every view kept before them (column ``signature``)."""
    keys = list(keys)

    def decide(pdf: pd.DataFrame) -> pd.Series:
        kept: list[np.ndarray] = []
        mask = []
        for signature in pdf["signature"]:
            new = np.asarray(signature, np.float64).reshape(cameras, 4)
            fresh = True
            if kept:
                old = np.stack(kept)
                turn = old[:, :, 3] - new[None, :, 3]
                turn = np.abs(np.arctan2(np.sin(turn), np.cos(turn)))
                centre = np.hypot(old[:, :, 0] - new[None, :, 0], old[:, :, 1] - new[None, :, 1])
                alike = (centre < centre_px) & (np.abs(old[:, :, 2] - new[None, :, 2]) < log_area) & (turn < np.radians(angle_deg))
                fresh = not alike.all(axis=1).any()
            mask.append(fresh)
            if fresh:
                kept.append(new)
        return pd.Series(mask)

    def without_conflicts(rows: DataFrame, kept: DataFrame) -> DataFrame:
        s = F.col("__s")
        near = with_cells(
            kept.select(*keys, F.col("signature").alias("__s")), (s[0], s[1]), (s[0], s[1]), centre_px, grow=centre_px
        )
        placed = rows.withColumn("cu", F.floor(F.col("signature")[0] / centre_px)).withColumn(
            "cv", F.floor(F.col("signature")[1] / centre_px)
        )
        condition = similar_views(
            placed["signature"], near["__s"], cameras, centre_px=centre_px, log_area=log_area, angle_deg=angle_deg
        )
        for k in [*keys, "cu", "cv"]:
            condition = condition & (placed[k] == near[k])
        return placed.join(near, condition, "left_anti").drop("cu", "cv")

    return greedy_keep(views, keys, order, [F.asc(order)], decide, without_conflicts, block=block)
