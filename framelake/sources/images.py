"""Images and depth arrays as tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_SUFFIXES = "*.{png,jpg,jpeg,bmp,PNG,JPG,JPEG,BMP}"


def scan_labelled_images(spark: SparkSession, root: str, aliases: DataFrame) -> DataFrame:
    """Images of a tree whose folders name the class: path, label_id, width, height, sha256, reason.

    A folder that is no class and a file that cannot be decoded stay as rows with a reason.
    """
    decoded = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", IMAGE_SUFFIXES
    ).load(root).select("image.origin", "image.width", "image.height")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_SUFFIXES).load(root).select(
        "path", F.sha2("content", 256).alias("sha256")
    )

    def plain(c: str):
        return F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/*", "/")

    pixels = decoded.select(plain("origin").alias("path"), "width", "height")
    return label_files(files.withColumn("path", plain("path")).join(pixels, "path", "left"), aliases)


def label_files(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the class named by each file's folder and the reason against the file (path, width, height)."""
    from framelake.functions.labels import alias_key

    keyed = files.withColumn("alias_key", alias_key(F.element_at(F.split("path", "/"), -2)))
    names = aliases.select("alias_key", F.col("class_id").alias("label_id"))
    reason = (
        F.when(F.col("label_id").isNull(), "unknown_label_directory")
        .when(F.col("width").isNull() | (F.col("width") <= 0), "unreadable_image")
        .otherwise("ok")
    )
    return keyed.join(names, "alias_key", "left").withColumn("reason", reason).drop("alias_key")


def decode_colour(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of colour images: path, u, v, b, g, r."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return image_pixels(images.select("image.*"))


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixels of decoded image rows (origin, height, width, nChannels, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for origin, height, width, channels, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                grid = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                colour = np.repeat(grid, 3, axis=2) if channels == 1 else grid[:, :, :3]
                rows, columns = np.indices((height, width))
                yield pd.DataFrame(
                    {"path": origin, "u": columns.ravel(), "v": rows.ravel(), **{n: colour[:, :, i].ravel().astype(int) for i, n in enumerate("bgr")}}
                )

    return images.mapInPandas(run, "path string, u int, v int, b int, g int, r int")


def decode_depth(spark: SparkSession, path: str, *, scale: float = 1.0) -> DataFrame:
    """Cells of .npy depth grids in millimetres: path, u, v, depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)
    return depth_cells(files.select("path", "content"), scale=scale)


def depth_cells(files: DataFrame, *, scale: float = 1.0) -> DataFrame:
    """Cells of depth arrays given as .npy bytes (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for origin, content in zip(pdf["path"], pdf["content"]):
                grid = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64) * scale
                rows, columns = np.indices(grid.shape)
                yield pd.DataFrame({"path": origin, "u": columns.ravel(), "v": rows.ravel(), "depth": grid.ravel()})

    return files.mapInPandas(run, "path string, u int, v int, depth double")


def replay_frames(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 1, form: str = "json") -> DataFrame:
    """Recorded frames as a stream that ends with the recording."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)
