"""Bounded training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import text_or_empty


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; an id of null has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """doc_id, text and y of at most `per_class` rows of each class, the first in hash order.

    `learn` is a condition on the labels' columns. Rows without a label are left out; of repeated labels the
    larger one counts, of repeated ids one text.
    """
    known = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.max(label) > 0).cast("int").alias("y"))
    )
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids, so the hint is safe at any size of the tables.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return texts.join(chosen, "doc_id").dropDuplicates(["doc_id"])
