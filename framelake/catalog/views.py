"""Stand-in inputs derived from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ident(*columns: str) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object of a frame; ids come from the row itself, so no window is needed."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.concat_ws(
            "-",
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            cents.cast("string"),
        ).alias("object_id"),
        (F.col("l_orderkey") % 8).alias("batch_id"),
        F.col("l_returnflag").alias("truth"),
        F.when(F.col("l_partkey") % 3 == 0, "A").when(F.col("l_partkey") % 3 == 1, "N").otherwise("R")
        .alias("prediction"),
        (F.col("l_linestatus") == "F").alias("accepted"),
        (F.col("l_partkey") % 640).cast("double").alias("x"),
        (F.col("l_suppkey") % 480).cast("double").alias("y"),
        F.col("l_quantity").alias("w"),
        (F.col("l_linenumber") + 1).cast("double").alias("h"),
        (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"),
        (F.col("l_tax") + F.lit(0.0)).alias("tax"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"),
    )


_DET = """
SELECT l_orderkey AS frame_id,
 concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice*100) AS BIGINT)) AS object_id,
 l_orderkey % 8 AS batch_id, l_returnflag AS truth,
 CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS prediction,
 l_linestatus = 'F' AS accepted,
 CAST(l_partkey % 640 AS DOUBLE) AS x, CAST(l_suppkey % 480 AS DOUBLE) AS y,
 l_quantity AS w, CAST(l_linenumber + 1 AS DOUBLE) AS h,
 1.0::DOUBLE - l_discount * 5 AS confidence, l_tax + 0.0::DOUBLE AS tax, l_extendedprice AS price,
 l_partkey AS part, l_suppkey AS supp, l_linenumber AS line
FROM lineitem"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed frames of many sessions; ``ns`` is integer time, ``hour`` an ordered bucket of it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("frame_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        (micros * 1000).alias("ns"),
        F.col("value").alias("value"),
        F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour"),
    )


#: Cells of the thumbnail that stands for a frame's picture.
THUMB_CELLS = 16


def thumbnail(value: Column) -> Column:
    """Sixteen grey levels made of a value: cells move apart and meet again as the value grows."""
    return F.transform(F.sequence(F.lit(0), F.lit(THUMB_CELLS - 1)), lambda i: F.floor(value * (1 + i % 4)).cast("bigint") % 64)


def thumb_sql(value: str) -> str:
    return f"[CAST(floor(({value}) * (1 + i % 4)) AS BIGINT) % 64 for i in range({THUMB_CELLS})]"


_FRAMES = """
SELECT user_id AS session_id, event_id AS frame_id, event_type AS kind, ts,
 epoch_us(ts) * 1000 AS ns, value, epoch_us(ts) // 3600000000 AS hour
FROM events"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.transform("embedding", lambda v: v.cast("double")).alias("v"),
    )


_VEC = """
SELECT vec_id AS id, 'c' || label AS label, [x::DOUBLE for x in embedding] AS v FROM embeddings"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score maps of two views with ten classes each."""

    def side(offset: int) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(f"c{i}") for i in range(10)]),
            F.array(*[F.exp(F.lit(8.0) * F.col("v")[offset + i]) for i in range(10)]),
        )

    return vectors(spark, sf_dir).select(
        "id",
        "label",
        side(0).alias("top"),
        side(10).alias("side"),
        F.least(F.lit(1.0), F.abs(F.col("v")[20]) * 4).alias("quality"),
        F.least(F.lit(1.0), F.abs(F.col("v")[21]) * 4).alias("topology"),
    )


_SCORES = """
SELECT id, label, i AS k, 'c' || i AS cls, exp(8.0 * v[i+1]) AS p, exp(8.0 * v[i+11]) AS s,
 least(1.0::DOUBLE, abs(v[21]) * 4) AS quality, least(1.0::DOUBLE, abs(v[22]) * 4) AS topology
FROM (SELECT id, label, v, unnest(range(10)) AS i FROM vec)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("object_id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_tax") * 100 + F.lit(0.0)).alias("y"),
        (F.lit(300.0) + F.col("l_extendedprice") / 1000).alias("z"),
    )


_PTS = """
SELECT l_suppkey AS object_id, l_quantity AS x, l_tax * 100 + 0.0::DOUBLE AS y,
 300.0::DOUBLE + l_extendedprice / 1000 AS z FROM lineitem"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth grids of 40 by 40 cells: every order is one cell, and 1,600 order keys make a frame."""
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 1600").alias("frame_id"),
        (F.col("o_orderkey") % 40).alias("u"),
        F.expr("(o_orderkey div 40) % 40").alias("v"),
        (F.col("o_totalprice") / 500).alias("depth"),
    )


_GRID = """
SELECT o_orderkey // 1600 AS frame_id, o_orderkey % 40 AS u, (o_orderkey // 40) % 40 AS v,
 o_totalprice / 500 AS depth FROM orders"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line segments, sixteen of each object."""
    return vectors(spark, sf_dir).select(
        F.expr("'c' || (id div 16)").alias("object_id"),
        F.col("id").alias("seg_id"),
        *[(F.col("v")[i] * 100).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.abs(F.col("v")[4]).alias("a"),
        F.abs(F.col("v")[5]).alias("b"),
        F.abs(F.col("v")[6]).alias("c"),
        (F.col("v")[7] > 0).alias("flag"),
    )


_SEG = """
SELECT 'c' || (id // 16) AS object_id, id AS seg_id, v[1]*100 AS x1, v[2]*100 AS y1, v[3]*100 AS x2, v[4]*100 AS y2,
 abs(v[5]) AS a, abs(v[6]) AS b, abs(v[7]) AS c, v[8] > 0 AS flag FROM vec"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample"),
        F.col("source").alias("batch_id"),
        F.col("lang").alias("label_id"),
        F.col("text").alias("content"),
        F.col("n_chars"),
    )


_DOCS = """
SELECT doc_id AS sample, source AS batch_id, lang AS label_id, text AS content, n_chars FROM documents"""

SQL_VIEWS = {
    "det": _DET,
    "frames": _FRAMES,
    "vec": _VEC,
    "scores": _SCORES,
    "pts": _PTS,
    "grid": _GRID,
    "seg": _SEG,
    "docs": _DOCS,
}
