"""What the leading bytes of a picture file say about it, read without decoding a pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the two file formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
JPEG_START = b"\xff\xd8\xff"
JPEG_FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
JPEG_BARE = (0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8)
JPEG_SCAN, JPEG_END, JPEG_APPLICATION = 0xDA, 0xD9, 0xE1
EXIF_MARK = b"Exif\x00\x00"
ORIENTATION_TAG = 0x0112


def tiff_orientation(data: bytes) -> int:
    """The orientation (1 to 8) in the first directory of an EXIF block; 1 where it says nothing usable."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return 1
    (place,) = struct.unpack_from(order + "I", data, 4)
    if place + 2 > len(data):
        return 1
    (entries,) = struct.unpack_from(order + "H", data, place)
    for at in range(place + 2, min(place + 2 + 12 * entries, len(data) - 11), 12):
        tag, kind = struct.unpack_from(order + "HH", data, at)
        if tag == ORIENTATION_TAG and kind == 3:
            (value,) = struct.unpack_from(order + "H", data, at + 8)
            return value if 1 <= value <= 8 else 1
    return 1


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of each chunk's content, cut short at the end of the data."""
    at = len(PNG_SIGNATURE)
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], at + 8, min(at + 8 + size, len(data))
        at += size + 12


def _png(data: bytes) -> tuple[int, int, int] | None:
    found = None
    turn = 1
    for kind, start, end in _png_chunks(data):
        if found is None:
            if kind != b"IHDR" or end - start != 13:
                return None
            found = struct.unpack_from(">II", data, start)
        elif kind == b"eXIf":
            turn = tiff_orientation(data[start:end])
            break
    return None if found is None else (*found, turn)


def _jpeg(data: bytes) -> tuple[int, int, int] | None:
    at, turn = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in JPEG_BARE:
            at += 2
            continue
        if marker in (JPEG_SCAN, JPEG_END):
            return None
        (size,) = struct.unpack_from(">H", data, at + 2)
        if marker in JPEG_FRAMES:
            if at + 9 > len(data):
                return None
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height, turn
        if marker == JPEG_APPLICATION and data[at + 4 : at + 10] == EXIF_MARK:
            turn = tiff_orientation(data[at + 10 : at + 2 + size])
        at += 2 + size
    return None


def picture_facts(data: bytes | None) -> tuple[str, int | None, int | None, int]:
    """(content type, stored width, stored height, orientation); no sizes where the header is damaged."""
    if data is None:
        return "application/octet-stream", None, None, 1
    if data.startswith(PNG_SIGNATURE):
        kind, found = "image/png", _png(data)
    elif data.startswith(JPEG_START):
        kind, found = "image/jpeg", _jpeg(data)
    else:
        return "application/octet-stream", None, None, 1
    if found is None or not (0 < found[0] < 1 << 31 and 0 < found[1] < 1 << 31):
        return kind, None, None, 1
    return kind, *found


FACTS = T.StructType(
    [
        T.StructField("content_type", T.StringType()),
        T.StructField("stored_width", T.IntegerType()),
        T.StructField("stored_height", T.IntegerType()),
        T.StructField("orientation", T.IntegerType()),
    ]
)


@F.pandas_udf(FACTS)
def _facts(content: pd.Series) -> pd.DataFrame:
    rows = [picture_facts(c) for c in content]
    kinds = ("object", "Int32", "Int32", "int32")
    return pd.DataFrame({f: pd.Series([r[i] for r in rows], dtype=k) for i, (f, k) in enumerate(zip(FACTS.names, kinds))})


def picture_header(content: str | Column) -> Column:
    """Content type, stored sizes and orientation of a picture file's bytes."""
    return _facts(F.col(content) if isinstance(content, str) else content)
