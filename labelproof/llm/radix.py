"""Distributed radix sort: rows get their places in the order of whole-number keys.

The sort goes from the last digit of the last key to the first digit of the first one. Rows lie in chunks of at most
``CHUNK_ROWS`` places. A pass counts rows by (chunk, digit); the rows of smaller digits, and those of the same digit in
earlier chunks, give each (chunk, digit) the place of its first row. Every chunk then counts its rows out in their old
order, so the pass is stable, and the rows go to the chunks of their new places. New places are dense, so chunks are of
equal size however the keys are spread: a key that half of the rows share fills no task.

The driver holds one number per digit value (at most ``1 << DIGIT_BITS``). Each pass is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.session import stored

CHUNK_ROWS = 1 << 14
DIGIT_BITS = 11
CHUNK, PLACE, DIGIT = "_chunk", "_place", "_digit"
PLACES = [T.StructField(CHUNK, T.LongType()), T.StructField(PLACE, T.IntegerType())]


@dataclass(frozen=True)
class Key:
    """A long column counted from zero: all values lie in 0 .. largest."""

    value: Column
    largest: int


def digits(keys: list[Key]) -> list[Column]:
    """The digits of the composite key, the least significant first, in passes of equal width."""
    found = []
    for key in reversed(keys):
        bits = key.largest.bit_length()
        passes = -(-bits // DIGIT_BITS)
        width = -(-bits // passes) if passes else 0
        for i in range(passes):
            found.append(F.shiftrightunsigned(key.value, i * width).bitwiseAND((1 << width) - 1).cast("int"))
    return found


def counted_out(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """One chunk's rows with their new places; ``offsets`` holds the place of the first row of each digit."""
    place = rows.column(PLACE).to_numpy()
    old_order = np.empty(len(place), np.int64)
    old_order[place] = np.arange(len(place))
    digit = rows.column(DIGIT).to_numpy()[old_order]
    counts = np.bincount(digit)
    first = np.zeros(len(counts), np.int64)
    first[offsets.column("value").to_numpy()] = offsets.column("first").to_numpy()
    # rows of equal digit stay in their old order
    by_digit = np.argsort(digit, kind="stable")
    nth = np.arange(len(digit)) - np.repeat(np.cumsum(counts) - counts, counts)
    new = first[digit[by_digit]] + nth
    moved = rows.drop_columns([CHUNK, PLACE, DIGIT]).take(pa.array(old_order[by_digit]))
    return moved.append_column(CHUNK, pa.array(new // CHUNK_ROWS)).append_column(
        PLACE, pa.array((new % CHUNK_ROWS).astype(np.int32))
    )


def one_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """The rows, sorted by ``digit`` and within it by their old places."""
    marked = rows.withColumn(DIGIT, digit)
    counts = marked.groupBy(CHUNK, DIGIT).agg(F.count("*").alias("n"))
    totals = sorted(counts.groupBy(DIGIT).agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for value, n in totals:
        starts.append((value, total))
        total += n
    begin = rows.sparkSession.createDataFrame(starts, f"{DIGIT} int, begin long")
    earlier = Window.partitionBy(DIGIT).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per digit value, so this side is broadcast
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(begin), DIGIT)
    offsets = offsets.select(
        F.col(CHUNK).alias("owner"), F.col(DIGIT).alias("value"), (F.col("begin") + F.col("before")).alias("first")
    )
    schema = T.StructType([f for f in rows.schema if f.name not in (CHUNK, PLACE)] + PLACES)
    moved = marked.groupBy(CHUNK).cogroup(offsets.groupBy("owner")).applyInArrow(counted_out, schema)
    return stored(moved, "radix")


def ranked(rows: DataFrame, keys: list[Key], rank: str) -> DataFrame:
    """The rows with ``rank`` from 1 in ascending order of ``keys``, in place of their chunk and place.

    ``rows`` holds ``CHUNK`` and ``PLACE``: any numbering of the rows in which the places of a chunk are dense from 0 and
    fewer than ``CHUNK_ROWS``, read from stored files so that it stays as it is. Rows equal in all keys follow it.
    """
    if rows.isEmpty():
        return rows.withColumn(rank, F.lit(None).cast("long")).drop(CHUNK, PLACE)
    # without a digit that differs one pass still turns places into ranks
    for digit in digits(keys) or [F.lit(0)]:
        rows = one_pass(rows, digit)
    return rows.withColumn(rank, F.col(CHUNK) * CHUNK_ROWS + F.col(PLACE) + 1).drop(CHUNK, PLACE)
