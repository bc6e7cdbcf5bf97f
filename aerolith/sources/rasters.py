"""Raster tiles as files: where each belongs and how large its image is; pixels are not decoded."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a PNG begins, and where its width and height stand (bytes, from 1).
PNG_MAGIC, PNG_WIDTH, PNG_HEIGHT = "89504E470D0A1A0A", 17, 21


def png_size(content: Column) -> Column:
    """struct<width, height> of a PNG; null if it is none."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    good = (F.hex(F.substring(content, 1, 8)) == PNG_MAGIC) & (F.octet_length(content) >= PNG_HEIGHT + 3)
    return F.when(good, F.struct(number(PNG_WIDTH).alias("width"), number(PNG_HEIGHT).alias("height")))


#: How a JPEG begins, the marks of frames that tell its size, and marks without a length.
JPEG_MAGIC, JPEG_FRAMES, JPEG_BARE = b"\xff\xd8", frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}, frozenset([0x01, *range(0xD0, 0xD9)])


def image_size(content: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of a PNG or JPEG from its head; None if it is neither or is cut off before them."""
    if content[:8].hex().upper() == PNG_MAGIC and len(content) >= PNG_HEIGHT + 3:
        return "png", *(int.from_bytes(content[at - 1 : at + 3]) for at in (PNG_WIDTH, PNG_HEIGHT))
    at = 2
    while content[:2] == JPEG_MAGIC and at + 9 <= len(content) and content[at] == 0xFF:
        mark = content[at + 1]
        if mark in JPEG_FRAMES:
            return "jpeg", int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
        at += 1 if mark == 0xFF else 2 if mark in JPEG_BARE else 2 + max(2, int.from_bytes(content[at + 2 : at + 4]))
    return None


#: Bytes within which an image's size is looked for; a JPEG's stands behind its notes.
HEAD_BYTES = 1 << 18


def image_sizes(content: Column) -> Column:
    """image_size as a column, for files of either format; where all files are PNG, png_size stays in generated code."""
    size = F.pandas_udf(lambda c: pd.DataFrame([image_size(x or b"") or (None, None, None) for x in c], columns=["format", "width", "height"]), "format string, width int, height int")
    return size(content)


def tiles_of_files(files: DataFrame) -> DataFrame:
    """z, x, y, width, height and content of files (path, content, ...) whose path ends in z/x/y and an extension; others are no tiles."""
    part = lambda k: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.\w+$", k)
    head = F.substring("content", 1, HEAD_BYTES)
    own = files.where(part(1) != "").withColumn("__size", image_sizes(head))
    return own.select(*(part(k).cast("int").alias(c) for k, c in ((1, "z"), (2, "x"), (3, "y"))), "__size.width", "__size.height", "content")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of all files below a path."""
    return tiles_of_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
