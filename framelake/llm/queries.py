"""The contract queries of the operators; each applies its operator to its whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, fim, hosts, jaccard, licenses, lines, mixing, packing, quality, suffixes, tokens, toxicity, trie
from framelake.llm.sample import remainder
from framelake.llm.sql import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
PACKING_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.token_counts(docs, public_tokenizers.path(TOKENIZER), limit=2048)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lines.dedup_lines(docs, min_chars=40, min_docs=5)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a passage of 50 words or more that another document has; others have no row."""
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    as_text = F.array_join(F.transform("spans", lambda s: F.concat(s["first"], F.lit("-"), s["last"])), ",")
    return found.select("doc_id", "n_repeated", "n_removable", as_text.alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return hosts.judge_documents(docs).select("doc_id", *hosts.COUNTS, "base_failed", "kept")


def op7_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    return quality.judged(toxicity.score(docs, model)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    network = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return quality.judged(quality.score(docs, network)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, threshold=(9, 10))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; one row for each piece of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack_documents(docs, public_tokenizers.path(PACKING_TOKENIZER), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's sample and of the text rebuilt from it."""
    samples = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return samples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    turns, ids = trie.share_openings(trie.numbered_turns(table(spark, sf_dir, "conversations")), every=20, upto=4)
    found = trie.prefix_trie(turns, ids)
    return found.nodes.join(trie.ends_digest(found.ends), ["conv_id", "depth"], "left").select(
        *found.nodes.columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_host_quality_rules": op6_host_quality_rules,
    "op7_toxicity_automata": op7_toxicity_automata,
    "op8_quality_cnn": op8_quality_cnn,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_retrieval_packing": op11_retrieval_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_trie": op13_conversation_trie,
    "pipeline": corpus_pipeline.run,
}
