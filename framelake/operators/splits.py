"""Deterministic splits, samples and deduplication.

Random draws are replaced by the order of a seeded hash, so a split depends on the ids alone and not on
the input order or partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.labels import split_rank_hash
from framelake.plans.scan import hash_bucket, ordinal, top_n_per_key


def _marked(df: DataFrame, group: str, item: str, seed: int) -> DataFrame:
    return df.withColumn("__h", split_rank_hash(seed, F.col(group), F.col(item)))


def _roles(df: DataFrame, group: str, item: str, n: int, seed: int, adaptive: bool, held: str, rest: str) -> DataFrame:
    """Marks the first ``n`` rows of each group in hash order as held out.

    Only those first rows are ranked (the limit runs before the shuffle); the last of them is the bar every
    row of the group is compared with, so a large group is never sorted.
    """
    hashed = _marked(df, group, item, seed)
    bar_of = F.struct(F.col("__h"), F.col(item))
    first = top_n_per_key(hashed.select(group, "__h", item), [group], [F.asc("__h"), F.asc(item)], n)
    sizes = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    wanted = F.least(F.lit(n), F.col("__size") - 1) if adaptive else F.lit(n)
    bars = (
        first.join(sizes, group)
        .filter(F.col("rank") <= wanted)
        .groupBy(group)
        .agg(F.max(bar_of).alias("__bar"))
    )
    inside = F.coalesce(bar_of <= F.col("__bar"), F.lit(False))
    return hashed.join(bars, group, "left").withColumn("role", F.when(inside, held).otherwise(rest)).drop("__h", "__bar")


def holdout_problems(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """Duplicate ids and groups too small to hold out ``n`` rows."""
    small = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") <= n)
    twice = df.groupBy(item).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return small.select(
        F.col(group).cast("string").alias("key"), F.concat(F.lit("needs at least "), F.lit(n + 1)).alias("problem"), "rows"
    ).unionByName(twice.select(F.col(item).cast("string").alias("key"), F.lit("duplicate id").alias("problem"), "rows"))


def group_holdout(df: DataFrame, group: str, item: str, *, n: int = 3, seed: int = 0, strict: bool = False) -> DataFrame:
    """Adds ``role`` (holdout or training): n rows per group, chosen by seeded hash.

    ``strict`` runs a check first and raises on duplicate ids and on groups of n rows or fewer.
    """
    if n <= 0:
        raise ValueError("holdout per group must be positive")
    if strict:
        bad = holdout_problems(df, group, item, n).take(1)
        if bad:
            raise ValueError(f"{bad[0]['key']}: {bad[0]['problem']}")
    return _roles(df, group, item, n, seed, False, "holdout", "training")


def adaptive_holdout(df: DataFrame, group: str, item: str, *, n: int = 3, seed: int = 0, held: str = "holdout", rest: str = "training") -> DataFrame:
    """As :func:`group_holdout`, but always leaves one training row; singletons all train."""
    return _roles(df, group, item, n, seed, True, held, rest)


def nested_split(
    df: DataFrame, group: str, item: str, *, n: int = 3, calibration: int = 3, seed: int = 0, frozen: DataFrame | None = None
) -> DataFrame:
    """Roles holdout, calibration and fit; a frozen id list replaces the outer draw."""
    if frozen is None:
        outer = group_holdout(df, group, item, n=n, seed=seed)
    else:
        marks = frozen.select(item, F.lit("holdout").alias("role"))
        outer = df.join(marks, item, "left").withColumn("role", F.coalesce("role", F.lit("training")))
    held = outer.filter("role = 'holdout'")
    inner = adaptive_holdout(
        outer.filter("role = 'training'").drop("role"), group, item, n=calibration, seed=seed + 1, held="calibration", rest="fit"
    )
    return held.unionByName(inner.select(*held.columns))


def split_counts(df: DataFrame, group: str, role: str = "role") -> DataFrame:
    return df.groupBy(group, role).agg(F.count(F.lit(1)).alias("rows"))


def stratified_folds(df: DataFrame, label: str, item: str, *, k: int = 3, seed: int = 0) -> DataFrame:
    """Adds ``fold``: each class shuffled by hash and dealt round-robin."""
    hashed = _marked(df, label, item, seed).withColumn("__b", hash_bucket(F.col("__h")))
    placed = ordinal(hashed, [label], "__b", ["__h", item], "__o")
    return placed.withColumn("fold", (F.col("__o") - 1) % k).drop("__h", "__b", "__o")


def stratified_sample(
    df: DataFrame, strata: Sequence[str], item: str, *, priority: str | None = None, per_stratum: int = 2, total: int = 24
) -> DataFrame:
    """A few rows per stratum, prioritised first, then the smallest ids until ``total`` rows."""
    first = [F.desc(priority)] if priority else []
    chosen = top_n_per_key(df, strata, [*first, F.asc(item)], per_stratum).drop("rank")
    rest = df.join(chosen.select(item), item, "left_anti").orderBy(item).limit(total)
    numbered = top_n_per_key(rest.withColumn("__one", F.lit(1)), ["__one"], [F.asc(item)], total)
    missing = chosen.agg((F.lit(total) - F.count(F.lit(1))).alias("__missing")).withColumn("__one", F.lit(1))
    fill = numbered.join(missing, "__one").filter(F.col("rank") <= F.col("__missing"))
    return chosen.unionByName(fill.select(*chosen.columns))


def distinct_per_group(df: DataFrame, group: str, variety: str, order: Sequence[str], *, n: int = 6) -> DataFrame:
    """First row of each variety in a group, then the first ``n`` of those."""
    rest = [c for c in df.columns if c not in (group, variety)]
    first = df.groupBy(group, variety).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(group, variety, "__r.*")
    return top_n_per_key(first, [group], [F.asc(c) for c in order], n).select(*df.columns)


def temporal_split(
    df: DataFrame, keys: Sequence[str], order: str, *, batch: str, train: Sequence, mixed: Sequence, validation: Sequence, first: int = 20, bucket_width: int = 1000
) -> DataFrame:
    """Role by batch; a mixed batch trains on its first rows per class and tests on the later ones."""
    bucketed = df.withColumn("__b", F.floor(F.col(order) / bucket_width))
    placed = ordinal(bucketed, keys, "__b", [order], "ordinal").drop("__b")
    role = (
        F.when(F.col(batch).isin(*train), "train")
        .when(F.col(batch).isin(*mixed), F.when(F.col("ordinal") <= first, "train").otherwise("test"))
        .when(F.col(batch).isin(*validation), "validation")
        .otherwise("unused")
    )
    return placed.withColumn("role", role)


def keep_first_by_hash(df: DataFrame, hash_column: str, order: Sequence[str], item: str) -> DataFrame:
    """Marks the first row of each content by ``order`` as kept and names it for the others."""
    first = df.groupBy(hash_column).agg(F.min_by(item, F.struct(*order)).alias("kept_item"))
    return df.join(first, hash_column).withColumn("kept", F.col(item) == F.col("kept_item"))


def review_ordinals(df: DataFrame, keys: Sequence[str], order: str, *, chosen: Sequence[int] = (1, 15, 30), bucket_width: int = 1000) -> DataFrame:
    """Rows at the chosen positions of each key."""
    bucketed = df.withColumn("__b", F.floor(F.col(order) / bucket_width))
    return ordinal(bucketed, keys, "__b", [order], "ordinal").drop("__b").filter(F.col("ordinal").isin(*chosen))
