"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # call sites of column expressions are looked up per call; costly for generated expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("labelproof")
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session.

    Executors must all see it, so a machine-local folder is used only for a
    local master that names no checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return qualified(spark, f"{base.rstrip('/')}/labelproof/{label}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, so that every reader and writer means the same place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file:///") else full


def make_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of redoing the work.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that has fewer splits than the session has cores, dealt out evenly.

    For row work that costs far more CPU than the rows cost to move. A large
    input has more splits than cores and stays as it is. Only for frames read
    straight from files: asking a frame with shuffles for its partitions runs them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan dealt by a key to at least four tasks for each core, however the scan is split.

    For small rows on which much work is done. Parquet splits that hold no start of a row group are empty: a file of one
    row group is one task's work, in however many splits it is read, so the number of splits does not tell.
    """
    wanted = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(wanted, key)


# splits of a scan that one task reads at most
SPLITS = 256


def gathered(files: DataFrame) -> DataFrame:
    """Rows of a scan of many small files in fewer, larger tasks, at least four for each core.

    Spark counts a file as 4 MB at least, so a task reads some thirty small files, or four where a session asks for
    splits of 16 MB; starting its Python workers then takes longer than the files do. A task gets at most ``SPLITS`` of
    its splits, of which rows are read one after another. Nothing is moved. Only for frames read straight from files.
    """
    parts = files.rdd.getNumPartitions()
    wanted = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-parts // SPLITS))
    return files.coalesce(wanted) if wanted < parts else files


def one_row(df: DataFrame) -> Column:
    """A frame of exactly one row as a struct column: a scalar subquery, so no join is planned."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
