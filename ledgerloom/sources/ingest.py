"""Uploaded files as rows: image tests, media types, pages and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import file_suffix

# Suffixes of images and their media types.
MEDIA = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff"}
MEDIA_TYPES = tuple(sorted(set(MEDIA.values())))


def is_image(name: Column, content_type: Column) -> Column:
    """IO3: by content type or by suffix, without regard to case."""
    return F.coalesce(F.lower(content_type).isin(*MEDIA_TYPES), F.lit(False)) | F.coalesce(file_suffix(name).isin(*MEDIA), F.lit(False))


def media_type(name: Column, content_type: Column) -> Column:
    """IO4: the content type if known, else by suffix, else JPEG."""
    by_suffix = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])[file_suffix(name)]
    return F.coalesce(F.when(F.lower(content_type).isin(*MEDIA_TYPES), F.lower(content_type)), by_suffix, F.lit("image/jpeg"))


def data_uri(media: Column, content: Column) -> Column:
    """S15."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.base64(content))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """IO1: files of a folder as filename, content and length. Files without content are left out by the scan; a folder without others is refused."""
    rows = spark.read.format("binaryFile").load(path)
    if rows.limit(1).count() == 0:
        raise ValueError("no files were uploaded")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.coalesce(F.nullif(name, F.lit("")), F.lit("uploaded-document")).alias("filename"), "content", "length", "path")


def split_pages(files: DataFrame, text: str = "text") -> DataFrame:
    """IO2 without a parser at hand: texts cut at form feeds, a row per page counted from 1."""
    return files.select("*", F.posexplode(F.split(F.col(text), "\f")).alias("page_index", "page_text")).withColumn("page_no", F.col("page_index") + 1).drop("page_index")


def parsed_parts(files: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """IO2: each file with the number of its pages (key, page_text) and `parse_error` where it has none."""
    counts = pages.filter(F.col("page_text").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"))
    return files.join(counts, key, "left").withColumns({"n_pages": F.coalesce("n_pages", F.lit(0).cast("bigint")), "parse_error": F.when(F.col("n_pages").isNull(), F.lit("the parser gave no pages"))})


def parse_pages(files: DataFrame, parser: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """IO2 with a parser of one's own: a function over Arrow batches, as for mapInArrow."""
    return files.mapInArrow(parser, schema)


def group_meta(parts: DataFrame) -> DataFrame:
    """Per group (group_id, part_no, filename, content_type, bytes) its name, size and whether all parts are images."""
    first = F.min_by("filename", "part_no")
    many = F.count(F.lit(1))
    return parts.groupBy("group_id").agg(
        many.alias("n_parts"),
        F.when(many == 1, first).otherwise(F.concat(many.cast("string"), F.lit(" files ("), first, F.lit(", ...)"))).alias("group_name"),
        F.sum("bytes").alias("total_bytes"),
        F.bool_and(is_image(F.col("filename"), F.col("content_type"))).alias("all_images"),
    )
