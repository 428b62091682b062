"""Image files as rows: bytes, and sizes from their headers, so that over-large ones are set aside before decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.image import IMAGE, from_plane, jpeg_size, packed
from ..functions.jpeg import jpeg_image

MAX_PIXELS = 3_500_000


def jpeg_files(spark: SparkSession, path: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """path, content, width, height and `rejected`: no-header or too-large where a file is not worth decoding."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg}").load(path)
    rows = rows.select("path", "content", jpeg_size(F.col("content")).alias("size"))
    why = F.when(F.col("size").isNull(), "no-header").when(F.col("size.width").cast("long") * F.col("size.height") > max_pixels, "too-large")
    return rows.select("path", "content", "size.width", "size.height", why.alias("rejected"))


def jpeg_images(spark: SparkSession, path: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """path, image and `rejected` (why there is none) of JPEG files; over-large ones are set aside by their headers."""
    rows = jpeg_files(spark, path, max_pixels).withColumn("d", jpeg_image(F.when(F.col("rejected").isNull(), F.col("content")), max_pixels))
    image = F.when(F.col("d.data").isNotNull(), F.struct("d.data", "d.width", "d.height"))
    return rows.select("path", image.alias("image"), F.coalesce("rejected", "d.rejected").alias("rejected"))


def camera_frames(planes: DataFrame) -> DataFrame:
    """planes (plane, width, height, stride, bgra and others) with `image` in place of the plane."""

    @F.pandas_udf(IMAGE)
    def decoded(plane: pd.Series, width: pd.Series, height: pd.Series, stride: pd.Series, bgra: pd.Series) -> pd.DataFrame:
        rows = [packed(from_plane(*r)) for r in zip(plane, width, height, stride, bgra, strict=True)]
        return pd.DataFrame(rows, columns=["data", "width", "height"])

    return planes.withColumn("image", decoded("plane", "width", "height", "stride", "bgra")).drop("plane")


def embedded(rows: DataFrame, load: Callable[[str], object], embed: Callable[[list], np.ndarray], batch: int = 32) -> DataFrame:
    """id, embedding, error of rows (id, address): what cannot be loaded has an error and no embedding.

    `load` and `embed` run in the tasks, `embed` on lists of at most `batch` loaded images.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part, images, errors = b.iloc[i : i + batch], [], []
                for address in part["address"]:
                    try:
                        images.append(load(address))
                        errors.append(None)
                    except Exception as e:  # one bad image must not fail the run
                        errors.append(str(e) or type(e).__name__)
                vectors = iter(embed(images)) if images else iter(())
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": [next(vectors) if e is None else None for e in errors], "error": errors})

    return rows.select("id", "address").mapInPandas(task, "id string, embedding array<float>, error string")
