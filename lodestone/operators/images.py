"""Sizes of images from their first bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """``(width, height)`` of a PNG, GIF, WebP or JPEG header."""
    d = bytes(data or b"")
    if d[:8] == b"\x89PNG\r\n\x1a\n" and d[12:16] == b"IHDR" and len(d) >= 24:
        return struct.unpack(">II", d[16:24])
    if d[:4] == b"GIF8" and len(d) >= 10:
        return struct.unpack("<HH", d[6:10])
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP" and len(d) >= 30:
        if d[12:16] == b"VP8X":
            return int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1
        if d[12:16] == b"VP8L":
            bits = int.from_bytes(d[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if d[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", d[26:30])
            return w & 0x3FFF, h & 0x3FFF
    if d[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(d):
            if d[at] != 0xFF:
                at += 1
            elif (kind := d[at + 1]) in (0xD8, 0x01, 0xFF) or 0xD0 <= kind <= 0xD7:
                at += 1 if kind == 0xFF else 2
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", d[at + 5 : at + 9])
                return w, h
            else:
                at += 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]
    return None


def size_column(content: Column) -> Column:
    """``struct<width, height>``, null fields where no header is known."""

    @F.pandas_udf("struct<width:int,height:int>")
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(d) or (None, None) for d in data], columns=["width", "height"]).astype("Int32")

    return run(content)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height`` of image files, by Spark's binary source."""
    rows = spark.read.format("binaryFile").load(path).select("path", size_column(F.col("content")).alias("s"))
    return rows.select("path", "s.width", "s.height")
