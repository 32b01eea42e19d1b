"""Greedy selection in a fixed order, exact for groups of any size.

A greedy pass keeps a row unless it conflicts with one kept before it, which depends on all earlier
decisions. Each round takes the next bounded block of open rows per key, decides that block in memory,
and drops every open row that conflicts with what was kept. Open rows never conflict with kept ones, so a
round keeps at least the first open row of each key. No task ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.plans.scan import top_n_per_key
from framelake.session import truncate_lineage


def greedy_keep(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    order: Sequence[Column],
    decide: Callable[[pd.DataFrame], pd.Series],
    without_conflicts: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    cap: int | None = None,
    block: int = 256,
) -> DataFrame:
    """Kept rows with their ``kept_rank`` per key; ``item`` identifies a row inside its key.

    ``decide`` gets one ordered block and returns a mask of the rows to keep. ``without_conflicts`` gets the
    open rows and the newly kept ones and returns the open rows that stay. With ``cap`` a key is closed
    once it has that many kept rows.
    """
    keys, columns = list(keys), df.columns
    schema = f"{_ddl(df)}, kept_rank bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rank", kind="stable").reset_index(drop=True)
        mask = decide(pdf).to_numpy(dtype=bool)
        kept = pdf.loc[mask, columns].head(cap).copy() if cap else pdf.loc[mask, columns].copy()
        kept["kept_rank"] = range(1, len(kept) + 1)
        return kept[[*columns, "kept_rank"]]

    open_rows = truncate_lineage(df)
    rounds: list[DataFrame] = []
    while True:
        head = top_n_per_key(open_rows, keys, order, block, "__rank")
        kept = truncate_lineage(head.groupBy(*keys).applyInPandas(run, schema))
        if kept.isEmpty():
            break
        if rounds:
            so_far = rounds[-1].groupBy(*keys).agg(F.max("kept_rank").alias("__before"))
            kept = kept.join(so_far, keys, "left").withColumn(
                "kept_rank", F.col("kept_rank") + F.coalesce("__before", F.lit(0))
            ).drop("__before")
            done = rounds[-1].unionByName(kept)
        else:
            done = kept
        rounds.append(truncate_lineage(done))
        decided = head.select(*keys, item)
        rest = without_conflicts(open_rows.join(decided, [*keys, item], "left_anti"), kept.drop("kept_rank"))
        if cap is not None:
            full = rounds[-1].groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= cap)
            rest = rest.join(full, keys, "left_anti")
        open_rows = truncate_lineage(rest)
        if open_rows.isEmpty():
            break
    if not rounds:
        return df.limit(0).withColumn("kept_rank", F.lit(None).cast("bigint"))
    out = rounds[-1]
    return out if cap is None else out.filter(F.col("kept_rank") <= cap)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
