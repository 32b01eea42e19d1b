"""Intermediate tables in the shared folder: written once, read again, and removed when nothing needs them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from framelake.session import scratch_path

_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    for paths in _open:
        paths.append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table as written: its size is known to the planner, and no later step computes it anew.

    The shuffle files behind it are of no more use; Spark removes them when the driver collects its garbage,
    which is asked for here, as a long job otherwise keeps them all on the executors' disks.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths made inside the block, for `remove`."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        # By identity: lists of blocks inside each other may be equal.
        _open[:] = [x for x in _open if x is not paths]


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
