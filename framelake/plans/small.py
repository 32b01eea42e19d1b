"""Small parameter tables and one-row results, built without a Python worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return f"{value!r}D" if isinstance(value, float) else str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A handful of parameter rows as a local relation whose size the planner knows."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    names = ", ".join(name for name, _ in fields)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row tables joined into one row."""
    out = frames[0].withColumn("__one", F.lit(1))
    for frame in frames[1:]:
        out = out.join(frame.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def one_row(long: DataFrame, key: str, values: dict[str, str], column: str) -> DataFrame:
    """Turns (key, column) rows into one row; ``values`` maps key to output name."""
    return long.agg(*[F.max(F.when(F.col(key) == k, F.col(column))).alias(n) for k, n in values.items()])
