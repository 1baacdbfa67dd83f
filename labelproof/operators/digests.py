"""Digests of tables that say which keys differ, compared level by level.

A row has four 64-bit hashes of all its columns, each with another start; a set of rows has their sums, kept as eight sums
of 32-bit halves. Sums do not depend on order and count repeated rows, and edits that cancel in one of eight sums do not
in the others. Rows fall into leaves by a hash of their key, leaves into nodes, and all nodes make up the table: the sums
of a level are added up from the level below. Two tables are compared by their roots; where these differ, by the digests
of the nodes, then by those of the leaves of unequal nodes, and only the rows of unequal leaves are compared by key.

A record holds the leaves (at most ``1 << LEAF_BITS`` rows) and every row's key and hashes, sorted by leaf, so that the
statistics of the files leave out what equal leaves hold. One digest per node goes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.operators.profile import whole_row_hash
from labelproof.session import shuffle_width

HASHES = 4
LANES = [f"lane{i}" for i in range(2 * HASHES)]
NODE_BITS = 6
LEAF_BITS = 16
LOW = (1 << 32) - 1


def lanes(columns: Sequence[str]) -> list[Column]:
    """The halves of the row's hashes; none is negative."""
    hashes = [whole_row_hash(sorted(columns), seed=i) for i in range(HASHES)]
    halves = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW)))]
    return [half.alias(name) for half, name in zip(halves, LANES)]


def added(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and sums of lanes per group; ``frame`` holds lanes and, above the lowest level, ``rows``."""
    count = F.sum("rows") if "rows" in frame.columns else F.count(F.lit(1))
    # sums are cut to 32 bits as a level is finished, so no level can overflow
    sums = [F.pmod(F.coalesce(F.sum(c), F.lit(0)), F.lit(1 << 32)).alias(c) for c in LANES]
    return frame.groupBy(*by).agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("rows"), *sums)


def digest() -> Column:
    """Rows and sums as one text."""
    return F.concat_ws(":", F.col("rows").cast("string"), F.sha2(F.concat_ws(",", *LANES), 256))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``fingerprint`` of the whole table, whatever its order."""
    # one row per task first, so that sums stay within their type however long the table is
    parts = added(df.select(F.spark_partition_id().alias("part"), *lanes(df.columns)), ["part"]).drop("part")
    return added(parts).select("rows", F.sha2(F.concat_ws(",", *LANES), 256).alias("fingerprint"))


def keyed_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key columns, leaf, node, lanes) of every row."""
    leaf = F.shiftrightunsigned(F.xxhash64(*key), 64 - LEAF_BITS).cast("int")
    rows = df.select(*key, leaf.alias("leaf"), *lanes(df.columns))
    return rows.withColumn("node", F.shiftright("leaf", LEAF_BITS - NODE_BITS))


def leaves_of(rows: DataFrame) -> DataFrame:
    return added(rows, ["node", "leaf"])


def record(df: DataFrame, key: Sequence[str], path: str) -> None:
    """Write the record of a table under ``path``."""
    width = shuffle_width(df.sparkSession)
    keyed_rows(df, key).repartition(width, "leaf").sortWithinPartitions("leaf").write.parquet(f"{path}/rows")
    leaves_of(df.sparkSession.read.parquet(f"{path}/rows")).coalesce(1).write.parquet(f"{path}/leaves")


def unequal(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose digests differ or that one side lacks."""
    a = left.select(*by, digest().alias("left_digest"))
    b = right.select(*by, digest().alias("right_digest"))
    return a.join(b, [*by], "full_outer").filter(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select(*by)


def changed_keys(df: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """(key columns, change): every key that was ``added``, ``removed`` or ``changed`` since the record was written.

    Rows of one key are compared together, so a repeated row that is lost or gained is a change of its key.
    """
    spark = df.sparkSession
    rows, before = keyed_rows(df, key), spark.read.parquet(f"{path}/rows")
    recorded, current = spark.read.parquet(f"{path}/leaves"), leaves_of(rows)
    # at most one row per node
    nodes = [r.node for r in unequal(added(recorded, ["node"]), added(current, ["node"]), ["node"]).collect()]
    suspect = F.col("node").isin(nodes) if nodes else F.lit(False)
    # at most one row per leaf
    leaves = F.broadcast(unequal(recorded.filter(suspect), leaves_of(rows.filter(suspect)), ["node", "leaf"]))
    sides = []
    for name, side in (("before", before), ("after", rows)):
        kept = side.filter(suspect).join(leaves, ["node", "leaf"], "left_semi")
        sides.append(added(kept, key).select(*[F.col(k).alias(f"{name}_{k}") for k in key], digest().alias(name)))
    # a null key is a key
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"before_{k}").eqNullSafe(F.col(f"after_{k}"))
    both = sides[0].join(sides[1], same, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    names = [F.when(F.col("after").isNull(), F.col(f"before_{k}")).otherwise(F.col(f"after_{k}")).alias(k) for k in key]
    return both.select(*names, change.alias("change"))
