"""Quality rules judged by host: failures per domain, shrunk with an empirical beta prior, joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.scratch import kept
from framelake.llm.text import SPACE, grams, mix, row_counts, slices, span_hashes, text_or_empty, texts, words

_FEED = np.arange(256) == 10
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Limits of the rules: symbols a word, share of repeated lines' count, and mean word length.
SYMBOLS_A_WORD, DUP_LINES_A_100_WORDS, WORD_CHARS = 0.1, 5, (2, 15)
#: A host is rejected for a rule when its shrunk failure rate is above this.
HOST_RATE = 0.5
#: The prior counts as this many documents at least and at most.
PRIOR_WEIGHT = (1.0, 1e6)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(array: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text of an Arrow column."""
    source = texts(array)
    data, starts = source
    n = len(array)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[starts[1:]] - total[starts[:-1]]

    in_word = ~SPACE[data]
    word = words(source, SPACE)
    line = words(source, _FEED)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=filled[1:])
    has_word = filled[line.end] > filled[line.start]
    line_row = line.row[has_word]
    hashes = span_hashes(data, line.start[has_word], line.end[has_word])
    first = np.unique(mix(hashes + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    value, at = grams(span_hashes(data, word.start, word.end), word.row, 3)
    value = mix(value + word.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, count = np.unique(value, return_inverse=True, return_counts=True)
    again = at[count[which] > 1] if len(at) else at
    covered = np.zeros(len(word.row), bool)
    for step in range(3):
        covered[again + step] = True
    return {
        "n_words": row_counts(word.row, n),
        "word_chars": per_row(in_word & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": row_counts(line_row, n) - row_counts(line_row[first], n),
        "n_repeat_words": row_counts(word.row[covered], n),
    }


def rules() -> dict[str, Column]:
    c = F.col
    return {
        "short": c("n_words") < 50,
        "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": c("n_symbols") > SYMBOLS_A_WORD * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > DUP_LINES_A_100_WORDS * c("n_words"),
        "word_length": ~(c("word_chars") / F.greatest(c("n_words"), F.lit(1))).between(*WORD_CHARS),
    }





def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, n and, for each rule, its shrunk failure rate `rate_<rule>` and `bad_<rule>`.

    Over hosts, the rates' weighted mean m and variance v give a beta prior of weight m(1-m)/v - 1 (kept in
    PRIOR_WEIGHT); a host's rate is (failures + weight * m) / (n + weight). The prior is a handful of numbers.
    """
    names = list(rules())
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"f_{r}") for r in names)
    )
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"f_{r}").alias(r) for r in names)).first()
    mean = {r: (total[r] or 0) / (total["n"] or 1) for r in names}
    spread = hosts.agg(
        *(F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.lit(mean[r]), 2)).alias(r) for r in names)
    ).first()
    out = {}
    for r in names:
        variance = (spread[r] or 0.0) / (total["n"] or 1)
        weight = mean[r] * (1 - mean[r]) / variance - 1 if variance > 0 else PRIOR_WEIGHT[1]
        weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        out[f"rate_{r}"] = (F.col(f"f_{r}") + F.lit(weight * mean[r])) / (F.col("n") + F.lit(weight))
    verdicts = hosts.select("host", "n", *(v.alias(k) for k, v in out.items()))
    return verdicts.withColumns({f"bad_{r}": F.col(f"rate_{r}") > HOST_RATE for r in names})


def judge_documents(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, failed_rules (array) and host of each row of `docs`.

    `host` names the domain, the column `source` if not given; null is a host of its own. A document goes if it
    fails a base rule, a rule for which its host is rejected, or two rules of any host. The counts are written
    once to the shared folder and read for the rates and for the verdict; texts are not shuffled. Null text has
    no words and so fails the base; equal rows stay separate; an empty table gives an empty result.
    """
    host = F.col("source") if host is None else host

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = text_counts(part.column("text"))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("host"), *(pa.array(found[k], pa.int64()) for k in COUNTS)],
                names=["doc_id", "host", *COUNTS],
            )

    rows = docs.select("doc_id", host.cast("string").alias("host"), text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, host string, " + ", ".join(f"{k} long" for k in COUNTS)
    counted = kept(rows.mapInArrow(count, schema), "quality-counts")
    names = rules()
    judged = counted.withColumns({f"fails_{r}": c for r, c in names.items()})
    verdicts = host_verdicts(judged).select(F.col("host").alias("its_host"), *(f"bad_{r}" for r in names))
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("its_host")), "left")
    failed = F.filter(F.array(*(F.when(F.col(f"fails_{r}"), F.lit(r)) for r in names)), lambda x: x.isNotNull())
    base = F.col("fails_short") | F.col("fails_repeats")
    by_host = F.lit(False)
    for r in names:
        by_host = by_host | (F.col(f"fails_{r}") & F.col(f"bad_{r}"))
    return joined.select(
        "doc_id",
        *COUNTS,
        base.alias("base_failed"),
        (~base & ~by_host & (F.size(failed) < 2)).alias("kept"),
        failed.alias("failed_rules"),
        "host",
    )
