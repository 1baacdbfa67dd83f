"""An image set drawn from the embeddings, so image operators run on files.

Every embedding becomes an 8x8 tile picture of 32x32 pixels. A few are left out,
damaged or blank so the checks have something to find.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions.images import image_hash, pixel_stats, png_bytes, tile_png, upright
from labelproof.schemas import Tables
from labelproof.session import dealt, scratch_path
from labelproof.sources.files import content_type, plain_path, read_images
from labelproof.sources.sinks import write_files

SQL_GALLERY = """
gallery AS (
  SELECT vec_id, label, vec_id % 25 = 3 AS missing, vec_id % 25 = 4 AS damaged, vec_id % 25 = 5 AS blank,
    CASE WHEN vec_id % 25 = 5 THEN list_transform(embedding, lambda v: 255::BIGINT)
         ELSE list_transform(embedding, lambda v: greatest(0, least(255, floor(v::DOUBLE * 400.0::DOUBLE + 128.0::DOUBLE)))::BIGINT) END AS levels
  FROM embeddings
)
"""


# A folder of very many files is listed, and its files are made, one after another; more than 32 folders are listed by tasks.
FOLDERS = 64


def file_name() -> Column:
    """Where a picture is under its folder, as ``name``."""
    return F.format_string("%02d/v%d.png", F.pmod("vec_id", F.lit(FOLDERS)), "vec_id").alias("name")


def levels(t: Tables) -> DataFrame:
    r = F.col("vec_id") % 25
    level = F.transform(
        "embedding",
        lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * F.lit(400.0) + F.lit(128.0)))).cast("int"),
    )
    # drawn and written by all tasks
    return dealt(t.embeddings, "vec_id").select(
        "vec_id", "label", F.when(r == 5, F.transform("embedding", lambda v: F.lit(255))).otherwise(level).alias("levels")
    )


def folder(t: Tables) -> str:
    """Folder of the picture files."""
    r = F.col("vec_id") % 25
    rows = levels(t).filter(r != 3)
    content = F.when(r == 4, F.lit("not an image").cast("binary")).otherwise(tile_png(F.col("levels"), 8, 4))
    return kept_folder(t, "gallery", rows.select(file_name(), content.alias("content")))


def kept_folder(t: Tables, label: str, named: DataFrame) -> str:
    """Folder with the files of ``named`` (name, content); written by the tasks that make them, once per query."""

    def write() -> str:
        path = scratch_path(t.spark, label)
        write_files(named, path, "name", "content").write.format("noop").mode("overwrite").save()
        return path

    return t.once(label, write)


# Sizes of the awkward set: files over the limit are not read.
AWKWARD_BYTES = 4096
AWKWARD_PIXELS = 20_000_000


@F.pandas_udf(T.BinaryType())
def _awkward(levels: pd.Series, kind: pd.Series, orientation: pd.Series) -> pd.Series:
    """The file of 8 x 6 tiles by its kind, stored so that turning it as stated puts the first tile top left."""
    out = []
    for values, k, o in zip(levels, kind, orientation):
        tiles = np.asarray(values, np.uint8)[:48].reshape(6, 8)
        image = np.kron(tiles, np.ones((2, 2) if k == 9 else (4, 4), np.uint8))
        data = png_bytes(upright(image, {6: 8, 8: 6}.get(o, o)), o)
        if k == 3:
            data = data.ljust(AWKWARD_BYTES + 1, b"\0")
        elif k == 4:
            data = b"not an image"
        elif k == 6:
            # a header of 30 million pixels, and nothing after it
            data = data[:16] + struct.pack(">II", 6000, 5001) + data[24:33]
        elif k == 7:
            data = data[: len(data) - 40]
        out.append(data)
    return pd.Series(out)


def awkward_folder(t: Tables) -> str:
    """Pictures that state all orientations, and files that admission has to turn down."""
    kind, turn = (F.col("vec_id") % 25).cast("int"), (F.col("vec_id") % 8 + 1).cast("int")
    rows = levels(t).select(file_name(), _awkward("levels", kind, turn).alias("content"))
    return kept_folder(t, "awkward", rows)


def key_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"v(\d+)\.png$", 1).cast("bigint")


def listed(t: Tables) -> DataFrame:
    """Manifest of the pictures: path, key, target, declared size."""
    base = folder(t)
    full = F.concat(F.lit(f"{base}/"), file_name())
    return t.embeddings.select("vec_id", "label", plain_path(full).alias("path"), F.lit("32x32").alias("image_size"))


def measured(t: Tables) -> DataFrame:
    """Manifest with file facts, decoded size and pixel statistics; missing files keep null metrics."""
    images = read_images(t.spark, folder(t), ("length", "sha256", "head")).withColumn("s", pixel_stats())
    facts = images.select("path", "length", "sha256", content_type(F.col("head")).alias("content_type"), "decoded", "width", "height", "s.*")
    joined = listed(t).join(facts, "path", "left")
    opened = F.coalesce("decoded", F.lit(False))
    return joined.withColumns(
        {
            "exists": F.col("length").isNotNull(),
            "opens_successfully": opened,
            "error": F.when(F.col("length").isNull(), "missing file").when(~opened, "unreadable file").otherwise(""),
            "brightness_mean": F.col("mean"),
            "contrast_std": F.col("std"),
        }
    )


def hashed(t: Tables) -> DataFrame:
    return read_images(t.spark, folder(t), ("sha256",)).filter("decoded").withColumn("bands", image_hash())
