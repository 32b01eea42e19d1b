"""Ordered computations over groups of any size.

A window over one key puts the whole key into one task. Here a key is cut into buckets that follow
the order (an hour of time, a prefix of a hash, a file block). Rows are windowed inside
``keys + bucket``; what a bucket has to know about earlier ones comes from a summary with one row per
bucket. The big side is shuffled once, on ``keys + bucket``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _local(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(value).over(window), F.lit(0))
    if kind == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``last`` (last non-null) along ``order``, adding the named columns.

    ``bucket`` must never decrease along ``order``. With ``exclusive`` the row itself is left out.
    """
    keys = list(keys)
    cells = [*keys, bucket]
    along = F.struct(*[F.col(name) for name in order])
    summary = []
    for name, (kind, value) in aggs.items():
        if kind == "sum":
            part = F.sum(value)
        elif kind == "max":
            part = F.max(value)
        elif kind == "last":
            part = F.max_by(value, F.when(value.isNotNull(), along))
        else:
            raise ValueError(f"unknown running aggregate: {kind}")
        summary.append(part.alias(f"__s_{name}"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.groupBy(*cells)
        .agg(*summary)
        .select(
            *cells,
            *[
                _local(kind, F.col(f"__s_{name}"), before).alias(f"__c_{name}")
                for name, (kind, _) in aggs.items()
            ],
        )
    )
    inside = (
        Window.partitionBy(*cells)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    out = df.join(carried, cells)
    columns = []
    for name, (kind, value) in aggs.items():
        here, carry = _local(kind, value, inside), F.col(f"__c_{name}")
        if kind == "sum":
            joined = carry + here
        elif kind == "max":
            joined = F.greatest(carry, here)
        else:
            joined = F.coalesce(here, carry)
        columns.append(joined.alias(name))
    return out.select(*[F.col(c) for c in df.columns], *columns)


def ordinal(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str = "ordinal"
) -> DataFrame:
    """1-based position of each row inside its key."""
    return running(df, keys, bucket, order, {name: ("sum", F.lit(1))})


def hash_bucket(hashed: Column, digits: int = 3) -> Column:
    """Bucket of a hex digest that keeps the digest's order (16**digits buckets)."""
    return F.substring(hashed, 1, digits)


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """First ``n`` rows of each key; the limit is applied on the map side before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
