"""Point clouds: planes, object features, projection and calibration checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import geometry
from framelake.functions.labels import split_rank_hash
from framelake.functions.numeric import clip, ratio, truth
from framelake.operators.grids import valid_depth
from framelake.plans.boxes import with_cells
from framelake.plans.quantiles import quantiles
from framelake.plans.scan import hash_bucket, ordinal

AXES = ("x", "y", "z")
_COV = [(i, j) for i in range(3) for j in range(i, 3)]


def depth_points(df: DataFrame, keys: Sequence[str], intrinsics: dict, *, stride: int = 1) -> DataFrame:
    """Valid depth pixels as camera points; every n-th of a frame in row-major order."""
    valid = df.filter(truth((F.col("depth") > 0) & ~F.isnan("depth")))
    if stride > 1:
        valid = ordinal(valid, keys, "v", ["u"], "__o").filter((F.col("__o") - 1) % stride == 0).drop("__o")
    ray = geometry.backproject(F.col("u"), F.col("v"), F.col("depth"), **{k: intrinsics[k] for k in ("fx", "fy", "cx", "cy")})
    return valid.withColumns(dict(zip(AXES, ray)))


def with_height(df: DataFrame, intrinsics: dict, normal: Sequence[float], offset: float) -> DataFrame:
    """Adds each depth pixel's height over the tray plane."""
    return df.withColumn(
        "height", geometry.height_above_plane(F.col("u"), F.col("v"), F.col("depth"), intrinsics, normal, offset)
    )


def plane_shift(df: DataFrame, keys: Sequence[str], *, foreground: float = 3.0, stride: int = 4, minimum: int = 100, low: float = 280.0, high: float = 1500.0) -> DataFrame:
    """Median height of sampled pixels near the plane; null with fewer than ``minimum`` (needs height)."""
    sampled = (F.col("u") % stride == 0) & (F.col("v") % stride == 0)
    near = valid_depth(F.col("depth"), low, high) & (F.abs("height") <= max(10.0, 2 * foreground))
    found = quantiles(df.filter(sampled & near), keys, F.col("height"), {"__m": 0.5}, count="pixels")
    every = df.select(*keys).distinct()
    return every.join(found, list(keys), "left").select(
        *keys, F.coalesce("pixels", F.lit(0)).alias("pixels"), F.when(F.col("pixels") >= minimum, F.col("__m")).alias("plane_shift")
    )


# Planes --------------------------------------------------------------------------------------------


def moments(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """Count, means and population covariances per key, as mergeable partial aggregates."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)],
        *[F.covar_pop(axes[i], axes[j]).alias(f"c{i}{j}") for i, j in _COV],
    )


def _matrices(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(pdf), 3, 3))
    for i, j in _COV:
        out[:, i, j] = out[:, j, i] = pdf[f"c{i}{j}"].to_numpy(float)
    return out


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def planes_from_moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares plane of each row of moments: unit normal with z <= 0, offset and RMSE.

    The 3x3 eigenproblems run batched on one aggregated row per key.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            values, vectors = np.linalg.eigh(_matrices(pdf))
            normal = vectors[:, :, 0]
            normal = np.where(normal[:, 2:3] > 0, -normal, normal)
            centre = pdf[["m0", "m1", "m2"]].to_numpy(float)
            out = pdf[keys].copy()
            out["nx"], out["ny"], out["nz"] = normal.T
            out["offset"] = -(normal * centre).sum(axis=1)
            out["rmse"] = np.sqrt(np.maximum(values[:, 0], 0.0))
            out["points"] = pdf["n"].to_numpy()
            yield out

    schema = f"{_ddl(rows, keys)}, nx double, ny double, nz double, offset double, rmse double, points bigint"
    return rows.filter("n >= 3").mapInPandas(run, schema)


def fit_plane(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return planes_from_moments(moments(df, keys), keys)


def fit_plane_ransac(df: DataFrame, keys: Sequence[str], item: str, *, threshold: float = 1.5, iterations: int = 80, seed: int = 0) -> DataFrame:
    """Plane through the largest set of inliers of sampled triples, refitted on them.

    Each of the ``iterations`` trials of a key draws three different points, by the trial's own seeded hash, from
    the key's points in hash order, so small groups have as many trials as large ones. All points of a key
    are tested against its triples; without a set of three inliers the plain fit is used.
    """
    keys = list(keys)
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    marked = df.withColumn("__h", split_rank_hash(seed, name, F.col(item))).withColumn("__b", hash_bucket(F.col("__h")))
    placed = ordinal(marked, keys, "__b", ["__h", item], "__o").select(*keys, (F.col("__o") - 1).alias("__o"), *AXES)
    n = F.col("__n")

    def draw(j: int, size: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col("trial"), F.lit(j), name), size)

    one, two = F.col("__r0"), F.col("__r1")
    low, high = F.least(one, two), F.greatest(one, two)
    third = F.col("__r2") + (F.col("__r2") >= low).cast("bigint")
    drawn = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(n >= 3)
        .withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .withColumns({"__r0": draw(0, n), "__s": draw(1, n - 1), "__r2": draw(2, n - 2)})
        .withColumn("__r1", F.pmod(one + 1 + F.col("__s"), n))
        .withColumn("__t", third + (third >= high).cast("bigint"))
        .select(*keys, "trial", F.posexplode(F.array("__r0", "__r1", "__t")).alias("slot", "__o"))
    )
    triples = drawn.join(placed, [*keys, "__o"]).groupBy(*keys, "trial").agg(
        *[F.max(F.when(F.col("slot") == s, F.struct(*AXES))).alias(f"p{s}") for s in range(3)]
    )
    a = [F.col(f"p1.{c}") - F.col(f"p0.{c}") for c in AXES]
    b = [F.col(f"p2.{c}") - F.col(f"p0.{c}") for c in AXES]
    normal = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    length = F.sqrt(geometry.dot(normal, normal))
    trials = triples.select(
        *keys, "trial", *[n.alias(f"__n{i}") for i, n in enumerate(normal)], length.alias("__l"), F.col("p0")
    ).filter(F.col("__l") >= 1e-8).select(
        *keys, "trial", *[(F.col(f"__n{i}") / F.col("__l")).alias(f"t{i}") for i in range(3)], "p0"
    ).withColumn("t3", -geometry.dot([F.col(f"t{i}") for i in range(3)], [F.col(f"p0.{c}") for c in AXES])).drop("p0")
    distance = F.abs(geometry.dot([F.col(c) for c in AXES], [F.col(f"t{i}") for i in range(3)]) + F.col("t3"))
    counts = df.join(trials, keys).groupBy(*keys, "trial").agg(F.count_if(distance <= threshold).alias("inliers"))
    best = counts.groupBy(*keys).agg(F.min_by("trial", F.struct(-F.col("inliers"), F.col("trial"))).alias("trial"), F.max("inliers").alias("inliers"))
    winner = best.filter("inliers >= 3").join(trials, [*keys, "trial"]).drop("trial")
    kept = df.join(winner, keys, "left").filter(F.col("t0").isNull() | (distance <= threshold))
    return fit_plane(kept, keys)


def local_plane(candidates: DataFrame, grid: DataFrame, keys: Sequence[str], item: str, *, radius: int, intrinsics: dict) -> DataFrame:
    """Plane, RMSE and valid ratio in a disk around each candidate pixel (keys, item, cu0, cv0).

    grid holds the allowed pixels (keys, u, v, depth; an invalid depth is null or not positive). Candidates meet the
    pixels around them tile by tile, and a tile gives one row of moments for each of its candidates.
    """
    keys, c, side = list(keys), F.col, 8.0 * radius
    good = truth((c("depth") > 0) & ~F.isnan("depth"))
    ray = geometry.backproject(c("u"), c("v"), c("depth"), **{k: intrinsics[k] for k in ("fx", "fy", "cx", "cy")})
    named = [c(k).isNotNull() for k in keys]
    spots = candidates.select(*keys, item, c("cu0").cast("double").alias("u"), c("cv0").cast("double").alias("v"))
    for known in named:
        spots, grid = spots.filter(known), grid.filter(known)
    spots = spots.withColumn("cu", F.floor(c("u") / side)).withColumn("cv", F.floor(c("v") / side))
    cloud = grid.withColumn("ok", good).select(
        *keys, c("u").cast("double").alias("u"), c("v").cast("double").alias("v"), "ok",
        *[F.when(c("ok"), r).cast("double").alias(a) for a, r in zip(AXES, ray)],
    )
    cloud = with_cells(cloud, (c("u"), c("v")), (c("u"), c("v")), side, grow=float(radius))
    names = ["n", "m0", "m1", "m2", *[f"c{i}{j}" for i, j in _COV]]

    def meet(spots: pa.Table, cloud: pa.Table) -> pa.Table:
        u, v, *axes = (cloud[name].to_numpy() for name in ("u", "v", *AXES))
        ok = cloud["ok"].to_numpy()
        around = np.nan_to_num(np.stack(axes, axis=1)) * ok[:, None]
        # Sums about the tile's centre lose no digits to a far origin.
        centre = around[ok].mean(axis=0) if ok.any() else np.zeros(3)
        around = (around - centre) * ok[:, None]
        terms = np.column_stack([np.ones(len(ok)), ok, around, *[around[:, i] * around[:, j] for i, j in _COV]])
        at = np.stack([spots[name].to_numpy() for name in ("u", "v")], axis=1)
        sums, step = np.empty((len(at), terms.shape[1])), max(1, 2**20 // max(len(ok), 1))
        for first in range(0, len(at), step):
            some = at[first : first + step]
            inside = (u - some[:, :1]) ** 2 + (v - some[:, 1:]) ** 2 <= radius * radius
            sums[first : first + step] = inside.astype(float) @ terms
        kept = np.flatnonzero(sums[:, 1] >= 3)
        n, sums = sums[kept, 1], sums[kept]
        means = sums[:, 2:5] / n[:, None]
        found = [n.astype(np.int64), *(means + centre).T]
        found += [sums[:, 5 + place] / n - means[:, i] * means[:, j] for place, (i, j) in enumerate(_COV)]
        some = spots.take(pa.array(kept))
        return pa.table({**{k: some[k] for k in [*keys, item]}, **dict(zip(names, map(pa.array, found))), "valid_ratio": pa.array(n / sums[:, 0])})

    schema = f"{_ddl(candidates, [*keys, item])}, n bigint, {', '.join(f'{x} double' for x in names[1:])}, valid_ratio double"
    tile = [*keys, "cu", "cv"]
    rows = spots.groupBy(*tile).cogroup(cloud.groupBy(*tile)).applyInArrow(meet, schema)
    fitted = planes_from_moments(rows, [*keys, item, "valid_ratio"])
    return fitted.select(*[n for n in fitted.columns if n != "valid_ratio"], "valid_ratio")


# Object features -------------------------------------------------------------------------------------


def principal_axes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axes (largest first) and sample eigenvalues from moments."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy(float)
            values, vectors = np.linalg.eigh(_matrices(pdf) * (n / np.maximum(n - 1, 1))[:, None, None])
            values, vectors = np.maximum(values[:, ::-1], 1e-9), vectors[:, :, ::-1]
            out = pdf[[*keys, "n", "m0", "m1", "m2"]].copy()
            for k in range(3):
                out[f"e{k}"] = values[:, k]
                for i in range(3):
                    out[f"a{k}{i}"] = vectors[:, i, k]
            yield out

    names = ["m0", "m1", "m2", *[f"e{k}" for k in range(3)], *[f"a{k}{i}" for k in range(3) for i in range(3)]]
    schema = f"{_ddl(rows, keys)}, n bigint, " + ", ".join(f"{n} double" for n in names)
    ordered = [*keys, "n", *names]

    def ordered_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            yield out[ordered]

    return rows.mapInPandas(ordered_run, schema)


def depth_spread(df: DataFrame, keys: Sequence[str], depth: str = "z") -> DataFrame:
    """2-98 % range, inter-quartile range and five-bin histogram of an object's depth."""
    keys = list(keys)
    marks = quantiles(df, keys, F.col(depth), {"p02": 0.02, "p25": 0.25, "p75": 0.75, "p98": 0.98})
    span = F.greatest(F.col("p98") - F.col("p02"), F.lit(1.0))
    place = clip((F.col(depth) - F.col("p02")) / span, 0.0, 1.0)
    cell = F.least(F.floor(place * 5), F.lit(4))
    histogram = df.select(*keys, depth).join(marks, keys).groupBy(*keys).agg(
        *[(F.count_if(cell == i) / F.count(F.lit(1))).alias(f"hist_{i}") for i in range(5)]
    )
    return marks.select(
        *keys, (F.col("p98") - F.col("p02")).alias("depth_range"), (F.col("p75") - F.col("p25")).alias("depth_iqr")
    ).join(histogram, keys)


#: Points of an object up to which its quantiles are read from sorted arrays.
FEW = 65_536
SPREAD = ("depth_range", "depth_iqr", *[f"hist_{i}" for i in range(5)])


def _between(values: np.ndarray, q: float) -> float:
    """The same linear interpolation as that of `quantiles`, of sorted values."""
    place = q * (len(values) - 1)
    low = int(np.floor(place))
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


def _known(values: np.ndarray) -> np.ndarray:
    return np.sort(values[~np.isnan(values)])


def _small_spans(df: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """Extents along the main axes and depth spread of objects that fit into a task's arrays: one shuffle of the points."""
    names = [*keys, "e", *SPREAD]

    def measure(cloud: pa.Table, axis: pa.Table) -> pa.Table:
        schema = pa.schema([*(axis.schema.field(k) for k in keys), pa.field("e", pa.list_(pa.float64())), *(pa.field(n, pa.float64()) for n in SPREAD)])
        if not cloud.num_rows or not axis.num_rows:
            return schema.empty_table()
        # A null becomes NaN; both have no place among the quantiles.
        point = [cloud[c].cast(pa.float64()).to_numpy().astype(float) for c in AXES]
        row = {n: axis[n][0].as_py() for n in axis.column_names}
        along = [sum(((point[i] - row[f"m{i}"]) * row[f"a{k}{i}"] for i in (1, 2)), (point[0] - row["m0"]) * row[f"a{k}0"]) for k in range(3)]
        along, depth = [_known(v) for v in along], _known(point[2])
        if not all(map(len, along)) or not len(depth):
            return schema.empty_table()
        extents = sorted((max(_between(v, 0.975) - _between(v, 0.025), 1e-3) for v in along), reverse=True)
        p02, p25, p75, p98 = (_between(depth, q) for q in (0.02, 0.25, 0.75, 0.98))
        place = np.where(np.isnan(point[2]), 1.0, np.clip((point[2] - p02) / max(p98 - p02, 1.0), 0.0, 1.0))
        cell = np.minimum(np.floor(place * 5), 4).astype(int)
        shares = np.bincount(cell, minlength=5) / len(cell)
        found = [extents, p98 - p02, p75 - p25, *shares.tolist()]
        return pa.table([*(axis[k].slice(0, 1) for k in keys), *(pa.array([f], schema.field(n).type) for n, f in zip(names[len(keys) :], found))], schema=schema)

    near = df.select(*keys, *AXES).join(axes.select(*keys), keys, "left_semi")
    schema = f"{_ddl(df, keys)}, e array<double>, {', '.join(f'{n} double' for n in SPREAD)}"
    return near.groupBy(*keys).cogroup(axes.groupBy(*keys)).applyInArrow(measure, schema)


def _large_spans(df: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """The same for objects of any size, whose points are ordered by several tasks."""
    local = df.join(axes, keys)
    place = [
        geometry.dot([F.col(c) - F.col(f"m{i}") for i, c in enumerate(AXES)], [F.col(f"a{k}{i}") for i in range(3)]) for k in range(3)
    ]
    long = local.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), p.alias("at")) for k, p in enumerate(place)])).alias("e")
    ).select(*keys, "e.*")
    spans = quantiles(long, [*keys, "axis"], F.col("at"), {"lo": 0.025, "hi": 0.975})
    extents = spans.groupBy(*keys).agg(
        F.reverse(F.array_sort(F.collect_list(F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-3))))).alias("e")
    )
    spread = depth_spread(df.join(axes.select(*keys), keys, "left_semi"), keys)
    return extents.join(spread, keys).select(*keys, "e", *SPREAD)


def object_features(df: DataFrame, keys: Sequence[str], *, minimum: int = 40, few: int = FEW) -> DataFrame:
    """Extents along the main axes, shape ratios, flatness and depth spread of each object.

    Objects of up to ``few`` points are measured in arrays, one object at a time, so their points are shuffled once and never
    aggregated as values; the others go through quantiles that several tasks share.
    """
    keys = list(keys)
    sums = moments(df, keys).filter(F.col("n") >= minimum)
    axes = principal_axes(sums, keys)
    spans = _small_spans(df, axes.filter(F.col("n") <= few), keys).unionByName(_large_spans(df, axes.filter(F.col("n") > few), keys))
    e = F.col("e")
    flat = planes_from_moments(sums, keys).select(*keys, F.col("rmse").alias("plane_rmse"))
    return axes.join(spans, keys).join(flat, keys).select(
        *keys, F.col("n").alias("points"), *[e[i].alias(f"extent_{i + 1}") for i in range(3)],
        (e[1] / e[0]).alias("extent_ratio_2"), (e[2] / e[0]).alias("extent_ratio_3"),
        (F.col("e1") / F.col("e0")).alias("eigen_ratio_2"), (F.col("e2") / F.col("e0")).alias("eigen_ratio_3"),
        "plane_rmse", *SPREAD,
    )


def principal_angles(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Main axis angle of each 2-D point set; 0 with fewer than three points."""
    angle = geometry.principal_angle(F.var_samp(x), F.var_samp(y), F.covar_samp(x, y))
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 3, F.lit(0.0)).otherwise(angle).alias("angle_deg"))


# Projection ---------------------------------------------------------------------------------------


def projected_roi(
    df: DataFrame, keys: Sequence[str], *, camera: dict, matrix: Sequence[Sequence[float]], normal: Sequence[float], offset: float,
    width: int, height: int, padding: float = 0.15,
) -> DataFrame:
    """Padded image box of an object and its foot points on the tray seen by the other camera.

    Every point and its foot is projected; the box of what falls on the image is padded and clipped. Null
    with fewer than three projected points or an empty box; visible_ratio is the share inside the image.
    """
    point = [F.col(c) for c in AXES]
    distance = geometry.signed_distance(point, normal, offset)
    foot = [p - distance * float(n) for p, n in zip(point, normal)]
    both = df.select(*keys, F.explode(F.array(*[F.struct(*[c.alias(a) for c, a in zip(p, AXES)]) for p in (point, foot)])).alias("p")).select(*keys, "p.*")
    seen = geometry.rigid_transform(point, matrix)
    u, v = geometry.project(*seen, **{k: camera[k] for k in ("fx", "fy", "cx", "cy")})
    pixels = both.select(*keys, u.alias("u"), v.alias("v")).filter("u is not null and v is not null")
    inside = F.col("u").between(0, width - 1e-9) & F.col("v").between(0, height - 1e-9)

    def edge(fn, name: str, top: int) -> Column:
        return F.rint(fn(clip(F.col(name), 0.0, top - 1.0)))

    boxes = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(inside.cast("double")).alias("visible_ratio"), F.bool_or(inside).alias("__any"),
        edge(F.min, "u", width).alias("u0"), edge(F.max, "u", width).alias("u1"),
        edge(F.min, "v", height).alias("v0"), edge(F.max, "v", height).alias("v1"),
    )
    w, h = F.col("u1") - F.col("u0") + 1, F.col("v1") - F.col("v0") + 1
    pad_x, pad_y = F.bround(w * padding, 0), F.bround(h * padding, 0)
    x0, y0 = F.greatest(F.lit(0.0), F.col("u0") - pad_x), F.greatest(F.lit(0.0), F.col("v0") - pad_y)
    x1, y1 = F.least(F.lit(float(width)), F.col("u0") + w + pad_x), F.least(F.lit(float(height)), F.col("v0") + h + pad_y)
    usable = (F.col("__n") >= 3) & F.col("__any") & (x1 > x0) & (y1 > y0)

    def kept(value: Column, name: str) -> Column:
        return F.when(usable, value).cast("bigint").alias(name)

    return boxes.select(*keys, "visible_ratio", kept(x0, "x"), kept(y0, "y"), kept(x1 - x0, "w"), kept(y1 - y0, "h"))


def footprint_support(df: DataFrame, keys: Sequence[str], roi: DataFrame, *, roi_keys: Sequence[str], intrinsics: dict, normal: Sequence[float], offset: float, lowest: float = 3.0, highest: float = 80.0) -> DataFrame:
    """Share of an object's elevated pixels whose foot on the tray falls on the tray region.

    df: keys, u, v, depth; roi: roi_keys, u, v.
    """
    ray = geometry.backproject(F.col("u"), F.col("v"), F.col("depth"), **{k: intrinsics[k] for k in ("fx", "fy", "cx", "cy")})
    lifted = df.withColumns(dict(zip(AXES, ray)))
    point = [F.col(c) for c in AXES]
    lifted = lifted.withColumn("height", geometry.signed_distance(point, normal, offset)).filter(F.col("height").between(lowest, highest))
    for c, n in zip(AXES, normal):
        lifted = lifted.withColumn(f"f{c}", F.col(c) - F.col("height") * float(n))
    fu, fv = geometry.project(F.col("fx"), F.col("fy"), F.col("fz"), **{k: intrinsics[k] for k in ("fx", "fy", "cx", "cy")})
    placed = lifted.select(*keys, F.rint(fu).cast("bigint").alias("u"), F.rint(fv).cast("bigint").alias("v"))
    marked = placed.join(roi.select(*roi_keys, "u", "v", F.lit(1).alias("__in")).dropDuplicates([*roi_keys, "u", "v"]), [*roi_keys, "u", "v"], "left")
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("elevated"), ratio(F.count("__in"), F.count(F.lit(1))).alias("support_ratio")
    ).withColumn("owned", F.col("support_ratio") >= 0.65)


def epipolar_p95(df: DataFrame, keys: Sequence[str], fundamental: Sequence[Sequence[float]]) -> DataFrame:
    """95th percentile of the point-to-epipolar-line distances in both images (pu, pv, su, sv)."""
    p, s = [F.col("pu"), F.col("pv"), F.lit(1.0)], [F.col("su"), F.col("sv"), F.lit(1.0)]
    in_side = [geometry.dot(p, [F.lit(float(v)) for v in row]) for row in fundamental]
    in_primary = [geometry.dot(s, [F.lit(float(row[i])) for row in fundamental]) for i in range(3)]

    def off(line: list[Column], point: list[Column]) -> Column:
        return F.abs(geometry.dot(line, point)) / F.greatest(F.hypot(line[0], line[1]), F.lit(1e-9))

    errors = df.select(*keys, F.explode(F.array(off(in_side, s), off(in_primary, p))).alias("error"))
    return quantiles(errors, keys, F.col("error"), {"epipolar_p95": 0.95})


def scale_error(df: DataFrame, keys: Sequence[str], *, size: float) -> DataFrame:
    """Median relative error of measured edge lengths against the known size (measured)."""
    return quantiles(df, keys, F.abs(F.col("measured") / float(size) - 1.0), {"scale_error": 0.5})
