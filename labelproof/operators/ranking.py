"""Exact ranks, running totals and quantiles that never need a whole group in one task.

A window over ``partitionBy(group)`` puts every row of a group in one task, so a
group holding a third of the table would stall the job. Here the rows of a
group are cut into ordered slices. Work inside a slice is a small window; what
a slice adds to the ones after it is an aggregate of one row per (group,
slice). Both steps shuffle on (group, slice), so a hot group is spread over as
many tasks as it has slices.

Slices come from a monotone function of the order column:

* ``draw_slice`` uses the leading digits of a hexadecimal hash draw, which are
  uniform by construction;
* ``value_slice`` uses approximate quantile cuts, so slices are balanced
  whatever the distribution. Cuts only balance the work: results are exact for
  any cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelproof.operators.skew import join_group_row, lookup_by_heavy_key
from labelproof.session import shuffle_width

SLICE = "__slice"


def hash_draw(seed: int | str, *keys: str) -> Column:
    """Reproducible random draw for a row: a hash of seed and key, input order plays no part."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def draw_number(draw: Column) -> Column:
    """First 32 bits of a hash draw as a BIGINT."""
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint")


def draw_slice(draw: Column, digits: int = 3) -> Column:
    """Slice id from the leading hex digits; ordered like the draw itself."""
    return F.coalesce(F.conv(F.substring(draw, 1, digits), 16, 10).cast("int"), F.lit(0))


def value_slice(df: DataFrame, column: str, source: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Add a slice id that grows with a non-null numeric column.

    One bounded pass over ``source`` (the rows the values come from; ``df``
    itself by default) finds the cuts, a few per shuffle partition; assignment
    is a binary search inside the JVM.
    """
    wanted = slices or 4 * shuffle_width(df.sparkSession)
    as_double = "__slice_key"
    keyed = df.withColumn(as_double, F.col(column).cast("double"))
    points = [i / wanted for i in range(1, wanted)]
    raw = (df if source is None else source).select(F.nanvl(F.col(column).cast("double"), F.lit(None)).alias(as_double))
    cuts = raw.approxQuantile(as_double, points, 1.0 / (2 * wanted))
    inner = sorted(set(cuts))
    if not inner:
        return keyed.drop(as_double).withColumn(SLICE, F.lit(0))
    splits = [float("-inf"), *inner, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=as_double, outputCol="__bucket").transform(keyed)
    # never null, so joins on the slice add no filter and both uses of the frame share one shuffle
    return bucketed.withColumn(SLICE, F.coalesce(F.col("__bucket").cast("int"), F.lit(0))).drop(as_double, "__bucket")


def _offsets(sized: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per (group, slice): size, what lies before it, and the group total.

    The window holds one row per slice of a group, a number fixed by the cuts.
    """
    part = W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy(F.lit(0))
    earlier = part.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).withColumn(
        "__total", F.sum("__size").over(part)
    )


def numbered(
    sliced: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    *,
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Exact 1-based row number inside each group (and optionally the group size).

    ``sliced`` carries a slice id that is monotone in the first order column;
    ``order`` must end in a unique key. Rows with a null group are not numbered
    (grouping drops them first).
    """
    keys = [*group, SLICE]
    rows = sliced
    for g in group:
        rows = rows.filter(F.col(g).isNotNull())
    sizes = _offsets(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")), group)
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = rows.withColumn("__local", local).join(sizes, keys)
    out = out.withColumn(rank, (F.col("__before") + F.col("__local")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("__total").cast("bigint"))
    return out.drop(SLICE, "__local", "__before", "__size", "__total")


def running_weights(sliced: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """For one row per (group, value): weight before it and the total weight of the group.

    Adds ``before`` and ``total`` (both BIGINT).
    """
    keys = [*group, SLICE]
    sizes = _offsets(sliced.groupBy(*keys).agg(F.sum(weight).alias("__size")), group)
    inside = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = sliced.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        local.join(sizes, keys)
        .withColumn("before", (F.col("__before") + F.col("__local")).cast("bigint"))
        .withColumn("total", F.col("__total").cast("bigint"))
        .drop(SLICE, "__local", "__before", "__size", "__total")
    )


def is_number(value: str, df: DataFrame) -> Column:
    """Neither null nor NaN: the values that ranks and quantiles are made of."""
    present = F.col(value).isNotNull()
    return present & ~F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else present


def value_weights(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values of a column per group with their row counts.

    Pre-aggregation: copies of one value collapse map-side, before any shuffle.
    """
    kept = df.filter(is_number(value, df))
    for g in group:
        kept = kept.filter(F.col(g).isNotNull())
    return kept.groupBy(*group, value).agg(F.count(F.lit(1)).alias("weight"))


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one output column per probability.

    The built-in ``percentile`` keeps every distinct value of a group in one
    aggregation buffer. Here slice totals tell which slices hold the wanted
    ranks and only those slices are ordered.
    """
    return weighted_quantiles(value_weights(df, group, value), group, value, probabilities, names)


def weighted_quantiles(
    weights: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """``exact_quantiles`` of rows that are already merged to one per (group, value) with their ``weight``."""
    keys = [*group, SLICE]
    weights = value_slice(weights, value)
    sizes = _offsets(weights.groupBy(*keys).agg(F.sum("weight").alias("__size")), group)
    last = F.col("__total") - 1
    wanted = []
    for p in probabilities:
        at = last.cast("double") * F.lit(float(p))
        wanted.append((F.floor(at), F.ceil(at), at - F.floor(at)))
    holds = F.lit(False)
    for low, high, _ in wanted:
        for r in (low, high):
            holds = holds | ((F.col("__before") <= r) & (r < F.col("__before") + F.col("__size")))
    needed = sizes.filter(holds)
    inside = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        weights.join(needed, keys)
        .withColumn("__from", F.col("__before") + F.coalesce(F.sum("weight").over(inside), F.lit(0)))
        .withColumn("__to", F.col("__from") + F.col("weight"))
    )
    picks = [F.max("__total").alias("__total")]
    for i, (low, high, _) in enumerate(wanted):
        for tag, r in (("l", low), ("h", high)):
            hit = (F.col("__from") <= r) & (r < F.col("__to"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{tag}{i}"))
    picked = placed.groupBy(*group).agg(*picks) if group else placed.agg(*picks)
    outputs = [F.col(g) for g in group]
    for i, name in enumerate(names):
        step = F.col(f"__h{i}") - F.col(f"__l{i}")
        outputs.append((F.col(f"__l{i}") + step * wanted[i][2]).alias(name))
    return picked.select(*outputs)


def top_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, *, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of each group. ``order`` must end in a unique key.

    The limit on ``row_number`` lets Spark keep only ``n`` rows per group in
    every map task before the shuffle, so a hot group does not travel whole.
    """
    name = rank or "__rank"
    kept = df.filter(" AND ".join(f"`{g}` IS NOT NULL" for g in group)) if group else df
    window = W.partitionBy(*[F.col(g) for g in group]).orderBy(*order)
    out = kept.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def value_counts_with_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """One row per distinct number: its average rank divided by the row count, and its rows."""
    weights = value_slice(value_weights(df, [], value), value, df)
    ranked = running_weights(weights, [], value, "weight")
    middle = F.col("before") + (F.col("weight") + 1) / F.lit(2.0)
    return ranked.select(F.col(value), (middle / F.col("total")).alias(out), F.col("weight").alias("__rows"))


def percent_rank_table(df: DataFrame, value: str, out: str) -> DataFrame:
    """One row per distinct value with its average rank divided by the row count.

    Ranks are worked out on (value, count), so neither ties nor a global order
    gather rows in one task.
    """
    return value_counts_with_rank(df, value, out).drop("__rows")


def average_percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank of a value divided by the row count, ties sharing their average rank; null for a null or NaN value.

    Only numbers are joined: rows without one would meet in a single task.
    """
    known = is_number(value, df)
    ranked = lookup_by_heavy_key(df.filter(known), value_counts_with_rank(df, value, out), value, "__rows").drop("__rows")
    return ranked.unionByName(df.filter(~known).withColumn(out, F.lit(None).cast("double")))


def with_group_row(df: DataFrame, table: DataFrame, group: Sequence[str], *, keep: bool = False) -> DataFrame:
    """Rows with the one row that ``table`` has for their group; ``keep`` also keeps rows without one.

    Groups may be few and hot: those of many rows are spread over as many tasks as their size asks for.
    """
    return join_group_row(df, table, group, "left" if keep else "inner")


def closest_to_median(df: DataFrame, group: Sequence[str], value: str, key: str) -> DataFrame:
    """One row per group: the one nearest the exact group median, lowest key on ties."""
    middle = exact_quantiles(df, group, value, [0.5], ["group_median"])
    distance = F.abs(F.col(value) - F.col("group_median"))
    near = with_group_row(df.filter(is_number(value, df)), middle, group).withColumn("distance", distance)
    return top_rows(near, group, ["distance", key], 1)


def accepted_until(df: DataFrame, group: str, order: str, accepted: str, n: int) -> DataFrame:
    """Rows seen while fewer than ``n`` rows of the group had been accepted.

    The n-th accepted row closes its group: later rows are dropped. Groups that
    never reach ``n`` keep every row. The closing position is a bounded top-n
    per group, so there is no running window over a whole group.
    """
    winners = top_rows(df.filter(F.col(accepted)), [group], [order], n, rank="__nth")
    closing = winners.filter(F.col("__nth") == n).select(group, F.col(order).alias("__closing"))
    closed = with_group_row(df, closing, [group], keep=True)
    return closed.filter(F.col("__closing").isNull() | (F.col(order) <= F.col("__closing"))).drop("__closing")


def first_accepted(df: DataFrame, entity: str, order: str, accepted: str) -> DataFrame:
    """Mark, among accepted rows, the first one of each entity: adds ``is_first``.

    ``order`` is unique, so the join back on it has no hot key.
    """
    firsts = (
        df.filter(F.col(accepted))
        .groupBy(entity)
        .agg(F.min(order).alias(order))
        .select(order, F.lit(True).alias("is_first"))
    )
    return df.join(firsts, order, "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
