"""File sources: CSV, JSON documents, catalogues, whole texts, binary files and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions.images import plain_pictures, turned
from labelproof.session import gathered, make_folder, scratch_path, stored
from labelproof.sources.sinks import write_files


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, keep_empty: bool = False) -> DataFrame:
    """CSV with a header and an explicit schema.

    ``keep_empty`` keeps empty text fields as empty strings; otherwise they are null.
    """
    frame = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    empty = F.lit("")
    if keep_empty:
        return frame.withColumns({c: F.coalesce(F.col(c), empty) for c in texts})
    return frame.withColumns({c: F.nullif(F.col(c), empty) for c in texts})


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as lower-cased text, one row per file."""
    frame = spark.read.text(path, wholetext=True)
    return frame.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.lower("value").alias("text"))


def plain_path(path: Column) -> Column:
    """``file:///x`` and ``file:/x`` written alike; other schemes stay."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size, SHA-256 and leading bytes of every file under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return file_facts(gathered(files)).drop("content")


def file_facts(files: DataFrame) -> DataFrame:
    """Path, size, SHA-256, leading bytes and content of the rows of a binary scan."""
    return files.select(
        plain_path(F.col("path")).alias("path"),
        "length",
        F.sha2("content", 256).alias("sha256"),
        F.substring(F.col("content"), 1, 8).alias("head"),
        "content",
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File listing without contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return gathered(files).select(plain_path(F.col("path")).alias("path"), "length")


def content_type(head: Column) -> Column:
    """Image type from the leading bytes."""
    text = F.hex(head)
    return F.when(text.startswith("89504E470D0A1A0A"), "image/png").when(text.startswith("FFD8FF"), "image/jpeg").otherwise(
        "application/octet-stream"
    )


# decoded pictures of at most so many bytes are kept from the one pass over the files
SMALL_PICTURE = 256 << 10


def read_images(spark: SparkSession, path: str, keep: Sequence[str] = (), *, turn: bool = True) -> DataFrame:
    """Decoded images, the right way up unless ``turn`` is off; a file that cannot be decoded stays, with null sizes.

    ``keep`` names columns of :func:`read_binary` to go with them, so that no file is opened twice for those.
    Spark's picture source takes milliseconds of fixed work for each file, however small. Plain PNG files are decoded
    where their bytes are read; only the others are copied to a folder of their own, which the picture source reads.
    It leaves out the orientation that a file states, so that is found by the header and the picture turned.

    The files are read once, when this is called: small pictures are kept as pixels in a few Parquet files. Those of
    more than ``SMALL_PICTURE`` bytes are decoded again when the rows are asked for, as rows of a Parquet file are read
    many at a time.
    """
    files = gathered(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    own = ["path", *keep]
    size = ["width", "height", "channels"]
    read = file_facts(files)
    folder = scratch_path(spark, "others")
    make_folder(spark, folder)
    split = plain_pictures(read, ["path", *dict.fromkeys([*keep, "length"])], turn=turn, most=SMALL_PICTURE)
    named = split.withColumn("opened_as", F.when(F.col("content").isNotNull(), F.sha2("path", 256)))
    held = [*dict.fromkeys([*own, "length"]), "orientation", *size, "pixels"]
    facts = stored(write_files(named, folder, "opened_as", "content", keep=held), "pictures")
    decoded = F.lit(True).alias("decoded")
    rows = facts.filter("pixels IS NOT NULL").select(*own, decoded, *size, "pixels")
    least = facts.filter("width IS NOT NULL AND pixels IS NULL").agg(F.min("length")).first()[0]
    if least is not None:
        large = plain_pictures(read.filter(F.col("length") >= least), own, turn=turn)
        rows = rows.unionByName(large.filter(F.length("pixels") > SMALL_PICTURE).select(*own, decoded, *size, "pixels"))
    return rows.unionByName(decoded_others(facts.filter("opened_as IS NOT NULL").select(*own, "orientation", "opened_as"), folder, own, turn))


def decoded_others(others: DataFrame, folder: str, own: Sequence[str], turn: bool) -> DataFrame:
    """Rows whose file is in ``folder`` as ``opened_as``, decoded by Spark's picture source and turned if so wished."""
    opened_as = F.element_at(F.split("path", "/"), -1).alias("opened_as")
    size = ["width", "height", "channels"]
    found = raw_images(others.sparkSession, folder).select(opened_as, "decoded", *size, "pixels")
    # the files' sizes say little about those of the pixels, which are not to pass through the driver
    rows = others.join(found.hint("merge"), "opened_as", "left").withColumn("decoded", F.coalesce("decoded", F.lit(False)))
    if not turn:
        return rows.select(*own, "decoded", *size, "pixels")
    # a null orientation is not turned
    asked = rows.withColumn("orientation", F.when(F.col("orientation") > 1, F.col("orientation")))
    upright = asked.withColumn("upright", F.when(F.col("orientation").isNotNull(), turned()))
    return upright.select(
        *own, "decoded", *[F.coalesce(f"upright.{c}", c).alias(c) for c in ("width", "height")], "channels",
        F.coalesce("upright.pixels", "pixels").alias("pixels"),
    )


def raw_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images as their pixels are stored."""
    frame = gathered(spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(path))
    opened = F.col("image.nChannels") > 0
    return frame.select(
        plain_path(F.col("image.origin")).alias("path"),
        opened.alias("decoded"),
        *[F.when(opened, F.col(f"image.{n}")).alias(c) for n, c in (("width", "width"), ("height", "height"), ("nChannels", "channels"))],
        F.when(opened, F.col("image.data")).alias("pixels"),
    )


CATALOGUE_TYPE = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def read_catalogue(spark: SparkSession, path: str, targets: Sequence[str]) -> DataFrame:
    """A JSON map of target to entity names as rows with their position.

    Names are trimmed and lower-cased. Raises when the file is no such map, a
    target is unknown, or a name is blank or repeated.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", CATALOGUE_TYPE).alias("m"))
    if parsed.filter(F.col("m").isNull() | F.exists(F.map_values("m"), lambda v: v.isNull())).take(1):
        raise ValueError("a catalogue must map each target to a list of names")
    rows = parsed.select(F.explode("m").alias("target", "names")).select("target", F.posexplode("names").alias("position", "name"))
    rows = rows.select("target", "position", F.lower(F.trim("name")).alias("name"))
    problems = catalogue_problems(rows, targets).limit(5).collect()
    if problems:
        raise ValueError(f"catalogue problems: {[tuple(r) for r in problems]}")
    return rows


def catalogue_problems(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Unknown targets, blank names and repeated names of an exploded catalogue."""
    unknown = rows.filter(~F.col("target").isin(*targets)).select(F.lit("unknown target").alias("problem"), F.col("target").alias("value"))
    blank = rows.filter(F.coalesce("name", F.lit("")) == "").select(F.lit("blank name").alias("problem"), F.col("target").alias("value"))
    repeated = rows.filter("name <> ''").groupBy("name").count().filter("count > 1")
    return unknown.distinct().unionByName(blank.distinct()).unionByName(
        repeated.select(F.lit("repeated name").alias("problem"), F.col("name").alias("value"))
    )
