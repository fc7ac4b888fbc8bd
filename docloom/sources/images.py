"""Images of document pages: media types, sizes and the pages that a prompt shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.retrieval import image_pages


def media_type(path: Column) -> Column:
    """By the extension; JPEG if it says nothing else."""
    ext = F.lower(F.regexp_extract(path, r"\.([a-zA-Z]+)$", 1))
    return F.concat(F.lit("image/"), F.when(ext.isin("png", "gif", "webp"), ext).otherwise("jpeg"))


def encoded(content: Column) -> Column:
    return F.base64(content)


def png_size(content: Column) -> Column:
    """Width and height in a PNG's header; null for other bytes."""
    at = lambda i: F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(at(17).alias("width"), at(21).alias("height")))


def fitted(width: Column, height: Column, most: int | None) -> Column:
    """The size after scaling so that the longer side is at most ``most``."""
    if most is None:
        return F.struct(width.alias("width"), height.alias("height"))
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def read_page_images(spark: SparkSession, folder: str) -> DataFrame:
    """Files {source_identifier}_p{page}.jpg as source_identifier, page_idx, media_type, data."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_p*.jpg").load(folder)
    name = F.regexp_extract("path", r"([^/]+)_p(\d+)\.jpg$", 1)
    return files.select(name.alias("source_identifier"), F.regexp_extract("path", r"_p(\d+)\.jpg$", 1).cast("int").alias("page_idx"), media_type(F.col("path")).alias("media_type"), encoded(F.col("content")).alias("data"))


def images_of(elements: DataFrame, images: DataFrame, most: int) -> DataFrame:
    """The images of the pages that elements lie on, in their order; pages without a file have null data. Only PDF elements have pages."""
    pages = image_pages(elements, most)
    return pages.join(images, ["source_identifier", "page_idx"], "left")
