"""Corpus pipeline: documents through five operators, each stage written to the shared folder and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, jaccard, lines, mixing, quality
from framelake.llm.sample import remainder
from framelake.llm.scratch import kept, noted, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage that was called last.
_earlier: list[str] = []


def _stage(work: Stage) -> Stage:
    """A stage's result is written before the next stage is called; then its intermediate tables go."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _earlier)
        _earlier.clear()
        with noted() as paths:
            out = work(spark, docs, sf_dir)
        _earlier.extend(paths)
        return out

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls good; it learns from the labelled documents outside the held-out fold."""
    learn = F.coalesce(remainder(F.col("doc_id"), 3) != 1, F.lit(False))
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", learn)
    scored = quality.score(docs, network, "__score")
    return scored.where(F.col("__score") >= 0.5).select(*_names(docs))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many have; n_chars is that of the text left."""
    return _recounted(lines.dedup_lines(docs), docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal texts (five words, 0.8), the one with the smallest id."""
    found = jaccard.jaccard_components(docs, shingle=5, threshold=(4, 5))
    return jaccard.nearest_kept(docs, found).select(*_names(docs))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that mostly consist of them go."""
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _recounted(found.where(~F.col("over_coverage")).withColumn("text", F.col("clean_text")), docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order of their sources."""
    return mixing.in_mixed_order(mixing.mix_sources(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
]

#: A network's decisions cannot be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    behind: list[str] = []
    for _, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        with noted() as paths:
            docs = kept(done, "corpus-stage")
        remove(spark, behind)
        behind = paths
    return docs


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{n}`") for n in docs.columns]


def _recounted(cut: DataFrame, docs: DataFrame) -> DataFrame:
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut.select(*(chars.alias(n) if n == "n_chars" else F.col(f"`{n}`") for n in docs.columns))
