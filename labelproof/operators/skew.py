"""Joins whose key may be held by a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
# rows of a group that one task may take, and how many parts all groups have beyond their first, at most
PART_ROWS = 1 << 20
MOST_PARTS = 10_000


def lookup_by_heavy_key(facts: DataFrame, table: DataFrame, key: str, rows: str, hot: int = HOT_KEYS) -> DataFrame:
    """Inner join of facts with a one-row-per-key table when some keys are very frequent.

    ``rows`` counts the facts of each key. Keys holding more than 1/``hot`` of
    all facts number at most ``hot``, so that part of the table is broadcast and
    its facts never shuffle; all other keys take the ordinary shuffle join.
    """
    limit = table.agg(F.sum(rows) / F.lit(hot)).scalar()
    flagged = table.withColumn("__hot", F.col(rows) > limit)
    heavy = flagged.filter("__hot").drop("__hot")
    light = flagged.filter("NOT __hot").drop("__hot")
    near = facts.join(F.broadcast(heavy), key)
    rest = facts.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return near.unionByName(rest.join(light, key))


def group_parts(df: DataFrame, group: Sequence[str], part_rows: int = PART_ROWS, most: int = MOST_PARTS) -> DataFrame:
    """(group, parts): the groups too large for one task, and over how many tasks each is to be spread.

    A group is cut by its own size into parts of ``part_rows`` rows; of larger ones where the table would have more than
    ``most`` parts, so this list has at most ``most`` rows. Sizes are counted before anything is shuffled.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    for g in group:
        sizes = sizes.filter(F.col(g).isNotNull())
    total = sizes.agg(F.sum("__n") / F.lit(most)).scalar()
    limit = F.greatest(F.lit(float(part_rows)), F.coalesce(total, F.lit(0.0)))
    return sizes.filter(F.col("__n") > limit).select(*group, F.ceil(F.col("__n") / limit).cast("bigint").alias("__parts"))


def join_group_row(
    df: DataFrame, table: DataFrame, group: Sequence[str], how: str = "inner", part_rows: int = PART_ROWS, most: int = MOST_PARTS
) -> DataFrame:
    """Rows joined with the one row that ``table`` has for their group.

    Rows of large groups are dealt over the parts of :func:`group_parts`, for each of which the group's row is
    repeated. All other groups are one part. Rows without a group meet nothing and are spread as well.
    """
    # at most ``most`` rows by construction
    parts = F.broadcast(group_parts(df, group, part_rows, most))
    draw = F.xxhash64(*df.columns)
    unknown = F.lit(False)
    for g in group:
        unknown = unknown | F.col(g).isNull()
    part = F.when(F.col("__parts").isNotNull(), F.pmod(draw, F.col("__parts"))).when(unknown, draw).otherwise(F.lit(0))
    dealt = df.join(parts, [*group], "left").select(*df.columns, part.cast("bigint").alias("__part"))
    last = F.coalesce(F.col("__parts"), F.lit(1)) - 1
    copies = table.join(parts, [*group], "left").select(*table.columns, F.explode(F.sequence(F.lit(0), last)).alias("__part"))
    return dealt.join(copies, [*group, "__part"], how).drop("__part")
