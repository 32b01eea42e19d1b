"""Audits of capture tables: counts, duplicates, coverage and collection targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the splits.
SPLITS = ("train", "probability_calibration", "final_holdout")


def dataset_audit(df: DataFrame) -> DataFrame:
    """Counts, mean valid ratio, largest delay and errors overall, per class and per batch.

    Needs label_id, batch_id, valid_ratio, sync_ms and a nullable ``error``. Faulty rows count as errors
    and stay out of the other numbers, but in ``samples`` of the overall row.
    """
    good = F.col("error").isNull()
    sets = df.groupingSets([["label_id"], ["batch_id"], []], "label_id", "batch_id").agg(
        F.grouping_id().alias("__g"),
        F.count(F.lit(1)).alias("samples"),
        F.count_if(good).alias("valid_samples"),
        F.coalesce(F.avg(F.when(good, F.col("valid_ratio"))), F.lit(0.0)).alias("mean_valid_ratio"),
        F.coalesce(F.max(F.when(good, F.col("sync_ms"))), F.lit(0.0)).alias("max_sync_ms"),
        F.count_if(~good).alias("errors"),
    )
    scope = F.when(F.col("__g") == 3, "all").when(F.col("__g") == 1, "class").otherwise("batch")
    key = F.coalesce(F.when(F.col("__g") == 1, F.col("label_id")).when(F.col("__g") == 2, F.col("batch_id")), F.lit(""))
    return sets.select(
        scope.alias("scope"), key.alias("key"), "samples", "valid_samples", "mean_valid_ratio", "max_sync_ms", "errors"
    )


def duplicate_hashes(df: DataFrame, hash_column: str) -> DataFrame:
    """Hashes met more than once, with their number of copies."""
    return (
        df.filter(F.col(hash_column) != "")
        .groupBy(hash_column)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def duplicate_members(df: DataFrame, hash_column: str) -> DataFrame:
    """The rows behind each duplicated hash, one per row (lists of paths would not be bounded)."""
    return df.join(duplicate_hashes(df, hash_column).select(hash_column), hash_column, "left_semi")


def image_audit(df: DataFrame, minimum: int = 5) -> DataFrame:
    """Long table: samples per class (flagged when few), per image size, and copies per hash."""
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    classes = df.groupBy(F.col("label_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sizes = df.groupBy(size.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    copies = duplicate_hashes(df, "sha256").select(F.col("sha256").alias("key"), F.col("copies").alias("n"))

    def section(name: str, part: DataFrame, warn: Column) -> DataFrame:
        return part.select(F.lit(name).alias("section"), "key", "n", warn.alias("warning"))

    return (
        section("class", classes, F.col("n") < minimum)
        .unionByName(section("size", sizes, F.lit(False)))
        .unionByName(section("duplicate", copies, F.lit(True)))
    )


def registry_by_split(registry: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Every enabled class with every split, so that empty cells are kept."""
    return registry.filter("enabled").select("class_id", F.explode(F.array(*map(F.lit, splits))).alias("split"))


def split_coverage(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Samples, colours and instances per class and split; zeros are kept."""
    counts = df.groupBy(F.col("label_id").alias("class_id"), "split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("color_id").alias("colours"),
        F.count_distinct("instance_id").alias("instances"),
    )
    return registry_by_split(registry).join(counts, ["class_id", "split"], "left").na.fill(
        0, ["samples", "colours", "instances"]
    )


def colour_coverage(df: DataFrame) -> DataFrame:
    return (
        df.filter("color_id is not null")
        .groupBy(F.col("label_id").alias("class_id"), "split", "color_id")
        .agg(F.count(F.lit(1)).alias("samples"))
    )


def instance_members(df: DataFrame) -> DataFrame:
    return (
        df.filter("instance_id is not null")
        .groupBy(F.col("label_id").alias("class_id"), "split", "instance_id")
        .agg(F.count(F.lit(1)).alias("samples"))
    )


def collection_targets(
    df: DataFrame,
    registry: DataFrame,
    *,
    counts: tuple[int, int, int] = (50, 15, 15),
    colours: int = 5,
    per_colour: tuple[int, int, int] = (10, 3, 3),
) -> DataFrame:
    """Five verdicts per class and their conjunction."""
    samples = df.groupBy(F.col("label_id").alias("class_id")).agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    )
    enough = colour_coverage(df).groupBy("class_id").agg(
        *[
            F.count_if((F.col("split") == s) & (F.col("samples") >= need)).alias(f"c_{s}")
            for s, need in zip(SPLITS, per_colour)
        ]
    )
    places = df.filter("instance_id is not null").groupBy(F.col("label_id").alias("class_id"), "instance_id").agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    )
    development = (F.col("train") == 1) | (F.col("probability_calibration") == 1)
    final = F.col("final_holdout") == 1
    instances = places.groupBy("class_id").agg(
        F.sum("train").alias("i_train"),
        F.sum("probability_calibration").alias("i_calibration"),
        F.sum("final_holdout").alias("i_final"),
        F.count_if(development & final).alias("i_shared"),
        F.count_if(development | final).alias("i_total"),
    )
    joined = (
        registry.filter("enabled").select("class_id")
        .join(samples, "class_id", "left").join(enough, "class_id", "left").join(instances, "class_id", "left")
        .na.fill(0)
    )

    def every(*conditions: Column) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c
        return out

    out = joined.select(
        "class_id",
        every(*[F.col(f"n_{s}") >= n for s, n in zip(SPLITS, counts)]).alias("counts_ok"),
        every(*[F.col(f"c_{s}") >= colours for s in SPLITS]).alias("colours_ok"),
        ((F.col("i_train") >= 2) & (F.col("i_calibration") >= 2)).alias("development_instances_ok"),
        ((F.col("i_final") > 0) & (F.col("i_shared") == 0)).alias("final_instance_new"),
        (F.col("i_total") >= 3).alias("three_instances"),
    )
    checks = [c for c in out.columns if c != "class_id"]
    return out.withColumn("ready", every(*[F.col(c) for c in checks]))


def targets_met(targets: DataFrame) -> DataFrame:
    return targets.agg(F.coalesce(F.bool_and("ready"), F.lit(True)).alias("collection_targets_met"))


def batch_counts(df: DataFrame, batch_id: str, platform_id: str | None = None) -> DataFrame:
    """Captures per label of one batch (and platform), to resume a session."""
    wanted = F.col("batch_id") == batch_id
    if platform_id is not None:
        wanted = wanted & (F.col("platform_id") == platform_id)
    return df.filter(wanted).groupBy("label_id").agg(F.count(F.lit(1)).alias("captures"))


def failure_denominator(population: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Rows per reason over the whole population; rows without an outcome count as ``missing``."""
    joined = population.select(key).join(outcomes.select(key, "reason"), key, "left")
    return joined.groupBy(F.coalesce("reason", F.lit("missing")).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def population_hash(df: DataFrame, id_column: str, *, digits: int = 6) -> DataFrame:
    """Hash tree over the ids, as one row; the same tree at every size.

    A leaf holds the ids whose SHA-256 begins with the same ``digits`` hex digits and is the SHA-256 of the JSON
    list of its sorted ids. Two digits at a time are then dropped: the node of a shorter prefix is the SHA-256
    of the JSON list of its (prefix, hash) entries in order. So no task holds more than a leaf or 256 entries.
    """

    def hashed(frame: DataFrame, key: Column, value: Column) -> DataFrame:
        return frame.groupBy(key.alias("leaf")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(value))), 256).alias("h"))

    ids = df.select(F.col(id_column).cast("string").alias("id"))
    level = hashed(ids, F.substring(F.sha2("id", 256), 1, digits), F.col("id"))
    for left in range(digits - 2, -1, -2):
        level = hashed(level, F.substring("leaf", 1, left) if left else F.lit(""), F.struct("leaf", "h"))
    return level.select(F.col("h").alias("population_hash"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights: rows / (classes x class rows)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("samples"))
    totals = counts.agg(F.sum("samples").alias("__rows"), F.count(F.lit(1)).alias("__classes"))
    joined = counts.withColumn("__one", F.lit(1)).join(totals.withColumn("__one", F.lit(1)), "__one")
    return joined.select(
        label, "samples", (F.col("__rows") / (F.col("__classes") * F.col("samples"))).alias("weight")
    )


def view_signature(corners: Column) -> Column:
    """Centre, log area and first-edge angle of an ordered outline (array of (x, y))."""
    size = F.size(corners)

    def mean(name: str) -> Column:
        return F.aggregate(corners, F.lit(0.0), lambda a, p: a + p[name]) / size

    steps = F.sequence(F.lit(0), size - 1)

    def turn(acc: Column, i: Column) -> Column:
        here, there = F.get(corners, i), F.get(corners, (i + 1) % size)
        return acc + here["x"] * there["y"] - there["x"] * here["y"]

    area = F.abs(F.aggregate(steps, F.lit(0.0), turn)) / 2.0
    first, second = F.get(corners, F.lit(0)), F.get(corners, F.lit(1))
    return F.struct(
        mean("x").alias("cx"),
        mean("y").alias("cy"),
        F.ln(F.greatest(area, F.lit(1.0))).alias("log_area"),
        F.atan2(second["y"] - first["y"], second["x"] - first["x"]).alias("angle"),
    )


def canonical_scores(df: DataFrame, key: str, scores: str, aliases: DataFrame) -> DataFrame:
    """Score maps with labels resolved by the registry; unknown labels stay and duplicates are summed."""
    from framelake.functions.labels import alias_key

    names = aliases.filter("enabled").select("alias_key", "class_id")
    long = df.select(key, F.explode(scores).alias("label", "p")).withColumn("alias_key", alias_key(F.col("label")))
    resolved = long.join(names, "alias_key", "left").withColumn("label", F.coalesce("class_id", "label"))
    return resolved.groupBy(key, "label").agg(F.sum("p").alias("p"))


def scores_to_map(long: DataFrame, key: str) -> DataFrame:
    """Back to one map per key (a score map has one entry per class)."""
    return long.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("scores"))
