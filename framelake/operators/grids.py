"""Depth grids and pixel sets as long tables (keys, u, v, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import geometry
from framelake.functions.numeric import clip, ratio, truth
from framelake.plans.quantiles import medians, quantiles


def neighbours(df: DataFrame, keys: Sequence[str], offsets: dict[str, tuple[int, int]], value: str = "depth") -> DataFrame:
    """Adds the value at each offset as a column, with one grouping instead of a join per offset.

    Every cell sends its value to the cells that see it at an offset; cells that hold no value of their
    own are dropped afterwards.
    """
    copies = [F.struct(F.col("u"), F.col("v"), F.lit("__own").alias("role"), F.col(value).alias("d"))]
    for name, (du, dv) in offsets.items():
        copies.append(
            F.struct((F.col("u") - du).alias("u"), (F.col("v") - dv).alias("v"), F.lit(name).alias("role"), F.col(value).alias("d"))
        )
    sent = df.select(*keys, F.explode(F.array(*copies)).alias("e")).select(*keys, "e.*")
    seen = sent.groupBy(*keys, "u", "v").agg(
        F.max(F.when(F.col("role") == "__own", F.col("d"))).alias(value),
        *[F.max(F.when(F.col("role") == n, F.col("d"))).alias(n) for n in offsets],
    )
    return seen.filter(F.col(value).isNotNull())


def valid_depth(value: Column, low: float = 280.0, high: float = 1500.0) -> Column:
    return truth(value.isNotNull() & ~F.isnan(value) & (value >= low) & (value <= high))


def centre(width: int, height: int) -> Column:
    """Middle three fifths of the grid."""
    return (
        (F.col("u") >= width // 5) & (F.col("u") < width * 4 // 5)
        & (F.col("v") >= height // 5) & (F.col("v") < height * 4 // 5)
    )


def depth_ratios(df: DataFrame, keys: Sequence[str], *, width: int, height: int, roi: Column | None = None, low: float = 280.0, high: float = 1500.0) -> DataFrame:
    """Share of valid cells over the whole grid, its centre and, if given, a region of it."""
    ok = valid_depth(F.col("depth"), low, high)
    inner = (width * 4 // 5 - width // 5) * (height * 4 // 5 - height // 5)
    out = [
        (F.count_if(ok) / float(width * height)).alias("valid_ratio"),
        (F.count_if(ok & centre(width, height)) / float(inner)).alias("center_ratio"),
    ]
    if roi is not None:
        out.append(ratio(F.count_if(ok & roi), F.count_if(roi)).alias("roi_ratio"))
    return df.groupBy(*keys).agg(*out)


def depth_quality(df: DataFrame, keys: Sequence[str], *, width: int, height: int, max_step: float = 10.0) -> DataFrame:
    """Valid and centre percent, noise between neighbours (steps 1 and 3) and depth range per frame."""
    keys = list(keys)
    valid = df.filter(truth((F.col("depth") > 0) & ~F.isnan("depth")))
    inner = (width * 4 // 5 - width // 5) * (height * 4 // 5 - height // 5)
    counts = valid.groupBy(*keys).agg(
        (F.count(F.lit(1)) * 100.0 / float(width * height)).alias("valid_percent"),
        (F.count_if(centre(width, height)) * 100.0 / float(inner)).alias("center_valid_percent"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
    )
    middle = medians(valid, keys, F.col("depth"), "median_depth")
    crop = valid.filter(centre(width, height))
    near = neighbours(crop, keys, {"r1": (1, 0), "d1": (0, 1), "r3": (3, 0), "d3": (0, 3)})
    steps = near.select(
        *keys,
        F.explode(
            F.array(*[
                F.struct(F.lit(s).alias("stride"), F.abs(F.col("depth") - F.col(n)).alias("d"))
                for n, s in (("r1", 1), ("d1", 1), ("r3", 3), ("d3", 3))
            ])
        ).alias("e"),
    ).select(*keys, "e.*").filter(F.col("d") <= max_step)
    p95 = quantiles(steps, [*keys, "stride"], F.col("d"), {"p95": 0.95})
    noise = p95.groupBy(*keys).agg(
        F.max(F.when(F.col("stride") == 1, F.col("p95"))).alias("difference_p95"),
        F.max(F.when(F.col("stride") == 3, F.col("p95"))).alias("stride3_difference_p95"),
    )
    same = steps.filter("stride = 1").groupBy(*keys).agg(
        ratio(F.count_if(F.col("d") == 0), F.count(F.lit(1))).alias("identical_ratio")
    )
    return counts.join(middle, keys, "left").join(noise, keys, "left").join(same, keys, "left").select(
        *keys, "valid_percent", "center_valid_percent", "difference_p95", "stride3_difference_p95",
        "identical_ratio", "min_depth", "median_depth", "max_depth",
    )


def metric_report(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """min, p05, median, p95 and max of each metric column."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("e")
    ).select("e.*").filter("x is not null")
    ends = long.groupBy("metric").agg(F.min("x").alias("min"), F.max("x").alias("max"))
    marks = quantiles(long, ["metric"], F.col("x"), {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return ends.join(marks, "metric")


# Backgrounds and regions -----------------------------------------------------------------------------


def background_difference(df: DataFrame, reference: DataFrame, cell: Sequence[str], values: Sequence[str], *, threshold: float = 22.0) -> DataFrame:
    """Pixels with their distance to the reference image; without a reference pixel the distance is null."""
    ref = reference.select(*cell, *[F.col(v).alias(f"__{v}") for v in values])
    total = None
    for v in values:
        term = (F.col(v) - F.col(f"__{v}")) ** 2
        total = term if total is None else total + term
    out = df.join(ref, list(cell), "left").withColumn("distance", F.sqrt(total))
    return out.withColumn("foreground", truth(F.col("distance") >= threshold)).drop(*[f"__{v}" for v in values])


def border_difference(df: DataFrame, keys: Sequence[str], values: Sequence[str], *, width: int, height: int, threshold: float = 22.0) -> DataFrame:
    """Distance of each pixel to the median of its frame's border."""
    keys = list(keys)
    edge = (F.col("u") == 0) | (F.col("u") == width - 1) | (F.col("v") == 0) | (F.col("v") == height - 1)
    border = df.filter(edge)
    out, total = df, None
    for v in values:
        out = out.join(quantiles(border, keys, F.col(v), {f"__{v}": 0.5}), keys, "left")
        term = (F.col(v) - F.col(f"__{v}")) ** 2
        total = term if total is None else total + term
    out = out.withColumn("distance", F.sqrt(total))
    return out.withColumn("foreground", truth(F.col("distance") >= threshold)).drop(*[f"__{v}" for v in values])


def median_background(df: DataFrame, keys: Sequence[str], value: str = "depth") -> DataFrame:
    """Per-pixel median over the frames of a batch."""
    return medians(df, [*keys, "u", "v"], F.col(value), value)


def depth_normalize(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth between its 2nd and 98th percentile scaled to 255 (near) .. 0 (far); invalid depth is 0."""
    keys = list(keys)
    ok = truth((F.col("depth") > 0) & ~F.isnan("depth"))
    marks = quantiles(df.filter(ok), keys, F.col("depth"), {"__lo": 0.02, "__hi": 0.98})
    span = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1.0))
    gray = F.floor(clip((F.col("__hi") - F.col("depth")) * 255.0 / span, 0.0, 255.0))
    return df.join(marks, keys, "left").withColumn("gray", F.when(ok, gray).otherwise(F.lit(0)).cast("int")).drop("__lo", "__hi")


def constrain_region(candidate: DataFrame, reference: DataFrame, keys: Sequence[str], *, max_growth: float = 1.5, min_overlap: float = 0.5) -> DataFrame:
    """Pixels of the live region per frame: kept, cut to the reference when it grew, or rejected.

    Returns keys, u, v, reason; a rejected frame has one row without a pixel.
    """
    keys = list(keys)
    marks = candidate.select(*keys, "u", "v", F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(
        reference.select(*keys, "u", "v", F.lit(0).alias("c"), F.lit(1).alias("r"))
    )
    pixels = marks.groupBy(*keys, "u", "v").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    counts = pixels.groupBy(*keys).agg(
        F.sum("c").alias("nc"), F.sum("r").alias("nr"), F.sum(F.col("c") * F.col("r")).alias("both")
    )
    state = (
        F.when(F.col("both") < F.greatest(F.lit(1.0), F.col("nr") * min_overlap), "tray_roi_reference_mismatch")
        .when(F.col("nc") <= F.col("nr") * max_growth, "kept")
        .otherwise("clamped")
    )
    verdict = counts.select(*keys, state.alias("reason"))
    kept = pixels.join(verdict, keys).filter(
        (F.col("c") == 1) & ((F.col("reason") == "kept") | ((F.col("reason") == "clamped") & (F.col("r") == 1)))
    )
    nothing = F.lit(None).cast(candidate.schema["u"].dataType)
    return kept.select(*keys, "u", "v", "reason").unionByName(
        verdict.filter("reason = 'tray_roi_reference_mismatch'").select(*keys, nothing.alias("u"), nothing.alias("v"), "reason")
    )


# Colours ---------------------------------------------------------------------------------------------


def neutral_gains(df: DataFrame, keys: Sequence[str], *, minimum: int = 100, low: float = 0.75, high: float = 1.33) -> DataFrame:
    """White-balance gains from the neutral pixels (b, g, r, s, val) of each batch's empty tray."""
    keys = list(keys)
    neutral = df.filter((F.col("s") < 65) & (F.col("val") > 60) & (F.col("val") < 245))
    long = neutral.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).cast("double").alias("x")) for c in "bgr"])).alias("e")
    ).select(*keys, "e.*")
    bands = quantiles(long, [*keys, "band"], F.col("x"), {"m": 0.5}, count="n")
    wide = bands.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg("m").alias("mean"), *[F.max(F.when(F.col("band") == c, F.col("m"))).alias(f"m_{c}") for c in "bgr"]
    )
    every = df.select(*keys).distinct().join(wide, keys, "left")
    gain = {c: F.col("mean") / F.greatest(F.col(f"m_{c}"), F.lit(1.0)) for c in "bgr"}
    outside = F.lit(False)
    for g in gain.values():
        outside = outside | (g < low) | (g > high)
    reason = (
        F.when(F.coalesce("n", F.lit(0)) < minimum, "insufficient_neutral_reference")
        .when(outside, "neutral_gains_out_of_range")
        .otherwise("batch_empty_tray")
    )
    marked = every.withColumn("reason", reason)
    used = F.col("reason") == "batch_empty_tray"
    return marked.select(
        *keys, F.coalesce("n", F.lit(0)).alias("pixels"), "reason",
        *[F.when(used, gain[c]).otherwise(F.lit(1.0)).alias(f"gain_{c}") for c in "bgr"],
    )


def colour_vector(df: DataFrame, keys: Sequence[str], *, minimum: int = 20, min_resultant: float = 0.75) -> DataFrame:
    """Five-number colour of an object: circular hue and Lab medians (8-bit h, s, val, l, a, b columns)."""
    keys = list(keys)
    chromatic = df.filter((F.col("s") >= 45) & (F.col("val") >= 18) & (F.col("val") < 250))
    angle = F.radians(F.col("h") * 2.0)
    hue = chromatic.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.cos(angle)).alias("hx"), F.avg(F.sin(angle)).alias("hy")
    )
    long = chromatic.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).cast("double").alias("x")) for c in "lab"])).alias("e")
    ).select(*keys, "e.*")
    marks = quantiles(long, [*keys, "band"], F.col("x"), {"m": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("band") == c, F.col("m"))).alias(f"m_{c}") for c in "lab"]
    )
    joined = df.select(*keys).distinct().join(hue, keys, "left").join(marks, keys, "left")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) < minimum, "insufficient_chromatic_interior")
        .when(F.hypot("hx", "hy") < min_resultant, "ambiguous_multiple_hues")
        .otherwise("accepted")
    )
    vector = F.array(
        "hx", "hy", (F.col("m_a") - 128) / 128, (F.col("m_b") - 128) / 128, F.col("m_l") / 255 * 0.15
    )
    return joined.withColumn("reason", reason).select(
        *keys, F.coalesce("n", F.lit(0)).alias("pixels"), "reason", F.when(F.col("reason") == "accepted", vector).alias("vector")
    )


def hue_split(df: DataFrame, keys: Sequence[str], *, gap: int, min_pixels: int, min_share: float = 0.18, rounds: int = 3) -> DataFrame:
    """Two circular hue clusters per component, if they are far enough apart and both large.

    df: keys, h (integer 0..179). The pixels are reduced to a 180-bin histogram first; the seeds and the
    fixed number of centre updates are array expressions on it, so a component of any size is one row.
    """
    keys = list(keys)
    bins = df.groupBy(*keys, F.col("h").cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    rows = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"), F.sum("n").alias("pixels"))
    index = F.sequence(F.lit(0), F.lit(179))

    def at(array: Column, i: Column) -> Column:
        return F.get(array, F.pmod(i, F.lit(180)).cast("int"))

    def apart(a: Column, b: Column) -> Column:
        d = F.abs(a - b)
        return F.least(d, 180.0 - d)

    rows = rows.withColumn("hist", F.transform(index, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")))
    rows = rows.withColumn(
        "smooth", F.transform(index, lambda i: sum((at(F.col("hist"), i + s) for s in (-2, -1, 1, 2)), at(F.col("hist"), i)))
    )
    rows = rows.withColumn("c0", (F.array_position("smooth", F.array_max("smooth")) - 1).cast("double"))
    rows = rows.withColumn(
        "far", F.transform(index, lambda i: F.when(apart(i.cast("double"), F.col("c0")) < gap, 0.0).otherwise(at(F.col("smooth"), i)))
    )
    rows = rows.withColumn("two", F.array_max("far") > 0)
    rows = rows.withColumn("c1", (F.array_position("far", F.array_max("far")) - 1).cast("double"))

    def first(i: Column) -> Column:
        return apart(i.cast("double"), F.col("c0")) <= apart(i.cast("double"), F.col("c1"))

    def weighted(member, fn) -> Column:
        return F.aggregate(
            index, F.lit(0.0), lambda acc, i: acc + F.when(member(i), at(F.col("hist"), i) * fn(F.radians(i * 2.0))).otherwise(0.0)
        )

    for _ in range(rounds):
        groups = {"c0": first, "c1": lambda i: ~first(i)}
        sums = {
            f"__{c}_{n}": weighted(member, fn)
            for c, member in groups.items()
            for n, fn in (("x", F.cos), ("y", F.sin), ("n", lambda a: F.lit(1.0)))
        }
        rows = rows.withColumns(sums)
        rows = rows.withColumns(
            {
                c: F.when(F.col(f"__{c}_n") > 0, F.pmod(F.degrees(F.atan2(f"__{c}_y", f"__{c}_x")) / 2.0, F.lit(180.0))).otherwise(F.col(c))
                for c in groups
            }
        )
    small = F.least("__c0_n", "__c1_n")
    split = F.col("two") & (apart(F.col("c0"), F.col("c1")) >= gap) & (
        small >= F.greatest(F.lit(float(min_pixels)), min_share * F.col("pixels"))
    ) & (F.col("pixels") >= 2 * min_pixels)
    return rows.select(
        *keys, "pixels", split.alias("split"),
        *[F.when(split, F.col(c)).alias(f"hue_{i}") for i, c in enumerate(("c0", "c1"))],
        *[F.when(split, F.col(f"__{c}_n").cast("bigint")).alias(f"pixels_{i}") for i, c in enumerate(("c0", "c1"))],
    )
