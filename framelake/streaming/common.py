"""Running streams to completion and writing them exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import scratch_path


def manifest_sink(stream: DataFrame, path: str, checkpoint: str, *, partitions: Sequence[str] = (), form: str = "json", available_now: bool = True):
    """Appends every accepted row once: file sink plus checkpoint. Returns the query."""
    writer = stream.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is available and returns the written table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = manifest_sink(stream, f"{path}/table", f"{path}/checkpoint", form="parquet")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def event_stream(spark: SparkSession, folder: str, file: str = "events.parquet") -> DataFrame:
    """The driver's event table as a stream, with a time zone so that watermarks accept it."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{file}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))
