"""Exact grouped quantiles for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one buffer. Here values are
counted per ``(key, value)``, the wanted ranks are located on a coarse histogram (256 cells per power of
two, so a key has a few thousand cells at most), and only the located cells are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_cell(value: Column, per_octave_bits: int = 8) -> Column:
    """Lower edge of the value's cell; never decreases when the value grows."""
    size = F.abs(value)
    rough = F.floor(F.log2(size))
    exponent = (
        F.when(F.pow(F.lit(2.0), rough) > size, rough - 1)
        .when(F.pow(F.lit(2.0), rough + 1) <= size, rough + 1)
        .otherwise(rough)
    )
    step = F.pow(F.lit(2.0), exponent - per_octave_bits)
    cell = F.floor(size / step) * step
    return F.when(value == 0, F.lit(0.0)).when(value > 0, cell).otherwise(-cell)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    wanted: dict[str, float],
    *,
    method: str = "linear",
    count: str | None = None,
) -> DataFrame:
    """One row per key with the wanted quantiles of the non-null values.

    ``linear`` interpolates at ``q*(n-1)``; ``nearest`` takes the value of rank ``ceil(q*n)``.
    """
    if method not in {"linear", "nearest"}:
        raise ValueError(f"unknown quantile method: {method}")
    keys = list(keys)
    named = [F.col(k) for k in keys] or [F.lit(0).alias("__all")]
    group = keys or ["__all"]
    values = (
        df.select(*named, value.cast("double").alias("__v"))
        .filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .withColumn("__v", F.col("__v") + F.lit(0.0))
        .groupBy(*group, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__cell", histogram_cell(F.col("__v")))
    )
    along = Window.partitionBy(*group).orderBy("__cell")
    whole = Window.partitionBy(*group)
    cells = (
        values.groupBy(*group, "__cell")
        .agg(F.sum("__n").alias("__cn"))
        .withColumn("__end", F.sum("__cn").over(along))
        .withColumn("__total", F.sum("__cn").over(whole))
        .withColumn("__start", F.col("__end") - F.col("__cn"))
    )

    total = F.col("__total")
    ranks: dict[str, tuple[Column, Column, Column]] = {}
    for name, q in wanted.items():
        if method == "linear":
            place = F.lit(float(q)) * (total - 1)
            low = F.floor(place)
            ranks[name] = (low, F.least(low + 1, total - 1), place - low)
        else:
            low = F.greatest(F.ceil(F.lit(float(q)) * total) - 1, F.lit(0))
            ranks[name] = (low, low, F.lit(0.0))

    def holds(rank: Column, start: str, end: str) -> Column:
        return (rank >= F.col(start)) & (rank < F.col(end))

    needed = F.lit(False)
    for low, high, _ in ranks.values():
        needed = needed | holds(low, "__start", "__end") | holds(high, "__start", "__end")
    located = cells.filter(needed).select(*group, "__cell", "__start", "__total")
    inside = Window.partitionBy(*group, "__cell").orderBy("__v")
    ordered = (
        values.join(located, [*group, "__cell"])
        .withColumn("__to", F.col("__start") + F.sum("__n").over(inside))
        .withColumn("__from", F.col("__to") - F.col("__n"))
    )
    picks = [F.max("__total").alias("__total")]
    for name, (low, high, _) in ranks.items():
        picks.append(F.max(F.when(holds(low, "__from", "__to"), F.col("__v"))).alias(f"__l_{name}"))
        picks.append(F.max(F.when(holds(high, "__from", "__to"), F.col("__v"))).alias(f"__h_{name}"))
    found = ordered.groupBy(*group).agg(*picks)
    out = [
        (F.col(f"__l_{name}") + (F.col(f"__h_{name}") - F.col(f"__l_{name}")) * part).alias(name)
        for name, (_, _, part) in ranks.items()
    ]
    if count:
        out.append(F.col("__total").alias(count))
    return found.select(*keys, *out)


def medians(df: DataFrame, keys: Sequence[str], value: Column, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def mad(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Median and median absolute deviation per key, in two passes."""
    keys = list(keys)
    group = keys or ["__all"]
    named = [F.col(k) for k in keys] or [F.lit(0).alias("__all")]
    base = df.select(*named, value.alias("__x"))
    centre = medians(base, group, F.col("__x"), "median")
    spread = medians(base.join(centre, group), group, F.abs(F.col("__x") - F.col("median")), "mad")
    return centre.join(spread, group).select(*keys, "median", "mad")
