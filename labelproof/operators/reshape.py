"""Skeletons, pivots, unpivots, unions and column order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literals(spark: SparkSession, values: Sequence, name: str, position: str | None = None) -> DataFrame:
    """A small fixed list as a frame, optionally with its 0-based position."""
    array = F.array(*[F.lit(v) for v in values])
    if position:
        return spark.range(1).select(F.posexplode(array).alias(position, name))
    return spark.range(1).select(F.explode(array).alias(name))


def in_order(column: str, values: Sequence) -> Column:
    """Sort position of a value in a fixed list; unknown values come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(F.coalesce(position, F.lit(0)) == 0, F.lit(len(values) + 1)).otherwise(position)


def leading_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns first, the others after them in their present order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def crosstab(
    df: DataFrame, row: str, column: str, values: Sequence, measure: Column | None = None, prefix: str = ""
) -> DataFrame:
    """Counts (or another measure) by row and column value, absent cells 0."""
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, list(values))
    wide = cells.agg(measure if measure is not None else F.count(F.lit(1)))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(f"{prefix}{v}") for v in values])


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def set_difference(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Distinct rows found on one side only, labelled by side; empty means equal sets.

    One shuffle on the whole row: presence flags are combined map-side first.
    """
    columns = left.columns
    tagged = left.withColumn("__side", F.lit(1)).unionByName(right.select(*columns).withColumn("__side", F.lit(2)))
    seen = tagged.groupBy(*columns).agg(F.bit_or("__side").alias("__side"))
    side = F.when(F.col("__side") == 1, F.lit(left_name)).otherwise(F.lit(right_name))
    return seen.filter(F.col("__side") != 3).select(*columns, side.alias("only_in"))
