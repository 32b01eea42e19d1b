"""Ids, aliases, paths, compositions and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.small import literal_table

# Shape class ids with their display names.
SHAPE_NAMES = {
    "triangular_prism": "三棱柱",
    "triangular_pyramid": "三棱锥",
    "square_pyramid": "四棱锥",
    "pentagonal_prism": "五棱柱",
    "pentagonal_pyramid": "五棱锥",
    "hexagonal_prism": "六棱柱",
    "hexagonal_pyramid": "六棱锥",
    "octahedron": "正八面体",
    "cone": "圆锥",
}
EMPTY_TRAY = "empty_tray"
EMPTY_TRAY_NAME = "空托盘"
# Fixed value: a misspelt colour that older records carry.
COLOUR_TYPOS = {"bule": "blue"}


def valid_id(value: Column) -> Column:
    return F.trim(value).rlike("^[A-Za-z0-9_-]+$")


def alias_key(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "-", "_"), r"\s+", "")


def canonical_colour(value: Column) -> Column:
    out = F.when(F.lit(False), value)
    for wrong, right in COLOUR_TYPOS.items():
        out = out.when(value == wrong, F.lit(right))
    return out.otherwise(value)


def class_key(colour: Column, shape: Column) -> Column:
    return F.concat_ws(":", colour, shape)


def display_name(colour: Column, shape: Column) -> Column:
    return F.concat(colour, shape)


def object_id(frame: Column, number: Column, width: int = 2) -> Column:
    """``frame-NN``; numbers longer than the width keep all their digits."""
    text = number.cast("string")
    return F.concat_ws("-", frame.cast("string"), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def relative_id(path: Column, root: str) -> Column:
    """Path below ``root`` with forward slashes."""
    unified = F.regexp_replace(path, r"\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(unified.startswith(prefix), F.substring(unified, len(prefix) + 1, 2**30)).otherwise(unified)


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the concatenated bytes of the parts, in order."""
    pieces = [p.cast("binary") for p in parts]
    return F.sha2(pieces[0] if len(pieces) == 1 else F.concat(*pieces), 256)


def signature(contract: str, *parts: Column) -> Column:
    """Content hash bound to a feature contract."""
    return content_hash(F.lit(contract), *parts)


def canonical_json_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def split_rank_hash(seed: int, group: Column, item: Column) -> Column:
    """Pseudo-random but reproducible order of the items of a group."""
    zero = F.char(F.lit(0))
    return F.sha2(F.concat(F.lit(str(seed)), zero, group.cast("string"), zero, item.cast("string")), 256)


def parse_composition(text: Column) -> Column:
    """``a:2, b`` to an array of (label, count); the count defaults to one."""
    items = F.filter(F.transform(F.split(text, "[,，;；]"), lambda p: F.trim(p)), lambda p: p != "")

    def entry(item: Column) -> Column:
        parts = F.split(item, "[:：=]", 2)
        count = F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("1"))
        return F.struct(F.trim(parts[0]).alias("label"), count.try_cast("int").alias("count"))

    return F.transform(items, entry)


def composition_counts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per key and label with repeated labels merged."""
    return (
        df.select(*keys, F.explode(parse_composition(F.col(text))).alias("__e"))
        .select(*keys, F.col("__e.label").alias("label"), F.col("__e.count").alias("count"))
        .groupBy(*keys, "label")
        .agg(F.sum("count").alias("count"))
    )


def composition_summary(entries: Column) -> Column:
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["label"], F.lit("x"), e["count"].cast("string"))), ", "
    )


def registry_frame(spark: SparkSession, classes: Sequence[tuple[str, str, str, Sequence[str], bool]]) -> DataFrame:
    """Registry table from (id, name, family, aliases, enabled) tuples."""
    return literal_table(
        spark,
        [(a, b, c, list(d), e) for a, b, c, d, e in classes],
        "class_id string, name string, family string, aliases array<string>, enabled boolean",
    )


def registry_aliases(registry: DataFrame) -> DataFrame:
    """One row per alias key; an alias owned by two classes is reported by ``alias_conflicts``."""
    spelled = F.array_union(F.array("class_id", "name"), F.col("aliases"))
    return (
        registry.select("class_id", "enabled", F.explode(spelled).alias("alias"))
        .select(alias_key(F.col("alias")).alias("alias_key"), "class_id", "enabled")
        .dropDuplicates(["alias_key", "class_id"])
    )


def alias_conflicts(registry: DataFrame) -> DataFrame:
    return (
        registry_aliases(registry)
        .groupBy("alias_key")
        .agg(F.count_distinct("class_id").alias("owners"))
        .filter("owners > 1")
    )


def registry_hash(registry: DataFrame) -> DataFrame:
    """Hash of the registry content in class order, as a one-row table."""
    line = F.to_json(F.struct("aliases", "class_id", "enabled", "family", "name"))
    return registry.agg(
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(line))), 256).alias("registry_hash")
    )
