"""Token counts of whole texts by a public tokenizer, without the tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import checked_columns, slices, text_or_empty

#: Distinct pieces whose length a task remembers; then it forgets all and goes on.
REMEMBERED = 300_000


def token_counts(docs: DataFrame, tokenizer_json: str, *, limit: int = 2048, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row.

    `tokenizer_json` is the path of a file of the `tokenizers` library; the driver reads it (a vocabulary,
    a few MB) and sends its content, so executors need no such file. Rows are cut into batches of about
    `batch_bytes` of text. Texts are split at single spaces and line feeds, which this kind of tokenizer drops
    and never merges over, so a text of any length is encoded in short pieces, equal pieces of a batch once.
    The tokenizer must drop white space (checked on a probe). Null text is empty: 0 bytes, 0 tokens. Equal
    rows stay separate rows, a null id stays null, an empty table gives an empty result.
    """
    with open(tokenizer_json, encoding="utf-8") as source:
        content = source.read()
    _probe(load_tokenizer(content))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_tokenizer(content)
        known: dict[str, int] = {"": 0}
        for part in slices(batches, most=batch_bytes):
            pieces = [(t or "").replace("\n", " ").split(" ") for t in part.column("text").to_pylist()]
            new = list(set().union(*pieces).difference(known))
            if len(known) + len(new) > REMEMBERED:
                known = {"": 0}
                new = list(set().union(*pieces).difference(known))
            known.update(zip(new, map(len, encoder.encode_batch_fast(new, add_special_tokens=False))))
            lengths = [sum(map(known.__getitem__, p)) for p in pieces]
            yield pa.record_batch(
                [part.column("doc_id"), part.column("n_bytes"), pa.array(lengths, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = checked_columns(docs, "doc_id", "text").select(
        "doc_id", text_or_empty().alias("text"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def load_tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_str(content)
    encoder.no_truncation()
    encoder.no_padding()
    return encoder


def _probe(encoder) -> None:
    whole = encoder.encode("one two\nthree", add_special_tokens=False).ids
    parts = [i for w in ("one", "two", "three") for i in encoder.encode(w, add_special_tokens=False).ids]
    if whole != parts:
        raise ValueError("this tokenizer encodes white space; texts cannot be split at it")
