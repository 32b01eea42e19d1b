"""Manifests: JSON lines with line numbers, faulty lines, sample trees, appends and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.labels import alias_key, content_hash
from framelake.plans.scan import ordinal

MANIFEST_SCHEMA = (
    "sample_dir string, batch_id string, label_id string, label_name string, frame_id string, timestamp_ns bigint, "
    "color_sha256 string, depth_sha256 string, valid_depth_ratio double, sync_delta_ms double"
)
SCENE_SCHEMA = (
    "sample_dir string, batch_id string, scene_id string, scene_index int, repeat_index int, "
    "objects array<struct<label_id:string,label_name:string,count:int>>, total_objects int, independent_layout boolean, "
    "valid_depth_ratio double, sync_delta_ms double, frame_id string, timestamp_ns bigint, color_sha256 string, depth_sha256 string"
)


def numbered_lines(spark: SparkSession, path: str, *, through: bool = False) -> DataFrame:
    """Lines of text files with their 1-based number: path, line_number, line.

    Files are read in splits; a line's number is its place in the split plus the lines of earlier splits,
    so one huge manifest is neither read nor numbered in a single task. With ``through`` the numbers run on from
    file to file in order of their names, as for a manifest that was written in sorted parts.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )
    if through:
        split = lines.withColumn("block", F.struct("path", "block"))
        return ordinal(split, [], "block", ["place"], "line_number").select("path", "line_number", "line")
    return ordinal(lines, ["path"], "block", ["place"], "line_number").select("path", "line_number", "line")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return numbered_lines(spark, path).filter(F.trim("line") != "").withColumn(
        "entry", F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA, *, root: str | None = None) -> DataFrame:
    """Well-formed entries with line_number and, given a root, the absolute sample folder."""
    good = _parsed(spark, path, schema).filter("entry is not null and entry._corrupt_record is null")
    out = good.select("entry.*", "line_number").drop("_corrupt_record")
    if root is not None:
        out = out.withColumn("absolute_sample_dir", F.concat_ws("/", F.lit(root.rstrip("/")), "sample_dir"))
    return out


def manifest_errors(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """Malformed lines with their number."""
    bad = _parsed(spark, path, schema).filter("entry is null or entry._corrupt_record is not null")
    return bad.select("line_number", "line", F.lit("invalid manifest JSON").alias("reason"))


def scan_samples(spark: SparkSession, root: str, aliases: DataFrame | None = None, *, name: str = "metadata.json") -> DataFrame:
    """Metadata of a tree of samples, one file each; see :func:`parse_samples`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return parse_samples(files, aliases)


def parse_samples(files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row for each metadata file (path, content): label from label_id, else label, else the folder above the sample.

    Samples that cannot be read stay as rows with a reason.
    """
    fields = "label_id string, label string, split string, human_reviewed boolean, instance_id string, color_id string, _corrupt_record string"
    parsed = files.select("path", F.from_json(F.decode("content", "utf-8"), fields, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    parts = F.split("path", "/")
    rows = parsed.select(
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("sample_dir"),
        F.coalesce("m.label_id", "m.label", F.element_at(parts, -3)).alias("raw_label"),
        "m.split", "m.human_reviewed", "m.instance_id", "m.color_id",
        (F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()).alias("__bad"),
    )
    if aliases is None:
        return rows.withColumn("label_id", F.col("raw_label")).withColumn("reason", F.when(F.col("__bad"), "invalid_metadata").otherwise("ok")).drop("__bad")
    names = aliases.select("alias_key", F.col("class_id").alias("label_id"), "enabled")
    joined = rows.withColumn("alias_key", alias_key(F.col("raw_label"))).join(names, "alias_key", "left")
    reason = (
        F.when(F.col("__bad"), "invalid_metadata").when(F.col("label_id").isNull(), "unknown_label")
        .when(~F.col("enabled"), "disabled_label").otherwise("ok")
    )
    return joined.withColumn("reason", reason).drop("__bad", "alias_key", "enabled")


def with_hashes(df: DataFrame, **parts: Sequence[Column]) -> DataFrame:
    """Adds one content hash per name over the given columns, in order."""
    return df.withColumns({name: content_hash(*columns) for name, columns in parts.items()})


def append_manifest(df: DataFrame, root: str, *, partitions: Sequence[str] = ("batch_id", "label_id")) -> None:
    """Appends entries as JSON lines below hive-style folders."""
    df.write.mode("append").partitionBy(*partitions).json(root)


def write_once(df: DataFrame, path: str, *, form: str = "json") -> None:
    """Writes a new table; an existing target is refused."""
    df.write.mode("errorifexists").format(form).save(path)


def write_reports(records: DataFrame, summary: DataFrame, confusion: DataFrame, root: str) -> None:
    """Summary and records as JSON, confusion matrix as CSV, below one folder."""
    summary.write.mode("errorifexists").json(f"{root}/summary")
    records.write.mode("errorifexists").json(f"{root}/records")
    confusion.write.mode("errorifexists").option("header", "true").csv(f"{root}/confusion")


def explode_results(frames: DataFrame, key: str = "frame_id", results: str = "results") -> DataFrame:
    """One row per detection out of nested per-frame results; a frame without any keeps an empty row."""
    return frames.select(key, F.explode_outer(results).alias("r")).select(key, "r.*")


def evaluation_records(results: DataFrame, samples: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flat evaluation table over detections, and reviewed objects that nothing detected.

    results: sample, object_id, mono_label, mono_reason, fused_label, fusion_state, status. samples: sample,
    split, is_multi, human_reviewed, label_id, association_ok (null without a review). reviews: sample,
    object_id, true_label, association_ok, side_occluded.
    """
    from framelake.functions.numeric import truth

    notes = reviews.select(
        "sample", "object_id", F.col("true_label").alias("r_label"), F.col("association_ok").alias("r_ok"), F.col("side_occluded").alias("r_occluded")
    )
    meta = samples.select(
        "sample", "split", "is_multi", "human_reviewed", "label_id", F.col("association_ok").alias("s_ok"), F.col("association_ok").isNotNull().alias("s_reviewed")
    )
    c = F.col
    seen = results.join(meta, "sample").join(notes.withColumn("reviewed", F.lit(True)), ["sample", "object_id"], "left")
    reviewed = truth(c("reviewed"))
    found = seen.select(
        "sample", "object_id", "split",
        (c("human_reviewed") & (~c("is_multi") | reviewed)).alias("human_reviewed"),
        F.when(c("is_multi"), c("r_label")).otherwise(c("label_id")).alias("true_label"),
        "mono_label", (F.coalesce("mono_reason", F.lit("accepted")) == "accepted").alias("mono_accepted"),
        "fused_label", (F.coalesce("fusion_state", F.lit("")) == "FUSED").alias("fused_accepted"),
        ((c("status") == "PICKABLE") & ~F.coalesce("mono_reason", F.lit("")).isin("accepted", "margin_rejected")).alias("safety_state_upgraded"),
        F.when(reviewed, truth(c("r_occluded"))).otherwise(F.coalesce("fusion_state", F.lit("")) == "SIDE_OCCLUDED").alias("side_occluded"),
        F.when(reviewed, ~truth(c("r_ok"))).otherwise(c("s_reviewed") & ~truth(c("s_ok"))).alias("association_error"),
        F.lit(False).alias("missed_object"),
    )
    unseen = notes.join(results.select("sample", "object_id"), ["sample", "object_id"], "left_anti").join(meta.filter("is_multi"), "sample")
    no, nothing = F.lit(False), F.lit(None).cast("string")
    missed = unseen.select(
        "sample", "object_id", "split", "human_reviewed", c("r_label").alias("true_label"), nothing.alias("mono_label"), no.alias("mono_accepted"),
        nothing.alias("fused_label"), no.alias("fused_accepted"), no.alias("safety_state_upgraded"), truth(c("r_occluded")).alias("side_occluded"),
        (~truth(c("r_ok"))).alias("association_error"), F.lit(True).alias("missed_object"),
    )
    return found.unionByName(missed)
