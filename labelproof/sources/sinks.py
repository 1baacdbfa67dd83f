"""Sinks: CSV, JSON reports, partitioned layouts, write-once results, Markdown, image files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions.text import markdown_cell
from labelproof.session import qualified


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is an empty field, empty text is a quoted empty field."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""')
    writer.csv(path)


def write_json_report(df: DataFrame, path: str, name: str = "rows") -> None:
    """A small report (one aggregate row or a bounded list) as one JSON document."""
    df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias(name))).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Folder layout by column values.

    Rows are clustered by the layout columns plus a key-free salt, so a hot
    folder is written by several tasks and each task opens few files.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    salted.repartition(*columns, "__salt").drop("__salt").write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write a result that must not exist yet."""
    try:
        df.write.mode("errorifexists").json(path)
    except AnalysisException as error:
        if "ALREADY_EXISTS" in (error.getCondition() or ""):
            raise FileExistsError(f"refusing to overwrite {path}") from error
        raise


def markdown_lines(df: DataFrame, order: Sequence) -> DataFrame:
    """A Markdown table as rows of text: header, rule, one line per row."""
    spark = df.sparkSession
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "---|" * len(df.columns)
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in df.columns]), F.lit(" |"))
    top = spark.range(1).select(F.explode(F.array(F.lit(head), F.lit(rule))).alias("line"))
    return top.unionAll(df.orderBy(*order).select(body.alias("line")))


def write_markdown(df: DataFrame, path: str, order: Sequence) -> None:
    """Gate tables are short; one file keeps the order of the lines."""
    markdown_lines(df, order).coalesce(1).write.mode("overwrite").text(path)


def write_files(df: DataFrame, folder: str, name: str, content: str, keep: Sequence[str] = ()) -> DataFrame:
    """Write one file per row from the tasks; returns the rows' names, sizes and the columns ``keep`` (lazy).

    A row without a name or content writes nothing and has no size. A name may have folders in it.

    Names and bytes depend on the row alone, so a retried task rewrites the same
    file. Any file system known to Arrow works; a folder without a scheme is one of the session's default file system.
    """
    target = qualified(df.sparkSession, folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(target)
        made = set()
        for batch in batches:
            sizes = []
            for file_name, data in zip(batch[name], batch[content]):
                if file_name is None or data is None:
                    sizes.append(None)
                    continue
                place = f"{base}/{file_name}"
                above = place.rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(place) as out:
                    out.write(bytes(data))
                sizes.append(len(data))
            yield batch[[*keep, name]].assign(bytes=pd.array(sizes, dtype="Int64"))

    fields = [*(df.schema[c] for c in keep), T.StructField(name, T.StringType()), T.StructField("bytes", T.LongType())]
    return df.select(*keep, name, content).mapInPandas(write, T.StructType(fields))
