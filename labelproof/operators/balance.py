"""Balance and association between a target and categorical or boolean fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.operators.evaluation import share

# Fixed limits: spread of a rate over targets, and association strength.
SERIOUS_SPREAD = 0.05
STRONG_ASSOCIATION = 0.3


def rates_and_means(df: DataFrame, target: str, flags: dict[str, Column], means: Sequence[str]) -> DataFrame:
    """Rate of each boolean flag and mean of each measure per target, one aggregate."""
    rows = F.count(F.lit(1))
    rates = [share(F.count_if(c), rows).alias(n) for n, c in flags.items()]
    return (
        df.filter(F.col(target).isNotNull())
        .groupBy(F.col(target).alias("target"))
        .agg(*rates, *[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in means])
    )


def rate_spreads(table: DataFrame, flags: Sequence[str]) -> DataFrame:
    """max - min of each rate over targets, the largest of them, and the seriousness flag."""
    one = table.agg(*[(F.max(f) - F.min(f)).alias(f"spread_{f}") for f in flags])
    names = [f"spread_{f}" for f in flags]
    top = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    return one.withColumn("max_spread", top).withColumn("serious", F.col("max_spread") > SERIOUS_SPREAD)


def conditional_counts(
    df: DataFrame, target: str, conditions: dict[str, Column], *, mean: str | None = None, minimum: str | None = None
) -> DataFrame:
    outputs = [F.count(F.lit(1)).alias("items"), *[F.count_if(c).alias(n) for n, c in conditions.items()]]
    if mean:
        outputs.append(F.avg(F.col(mean).cast("double")).alias(f"mean_{mean}"))
    if minimum:
        outputs.append(F.min(minimum).alias(f"minimum_{minimum}"))
    return df.groupBy(F.col(target).alias("target")).agg(*outputs)


def unequal_multisets(df: DataFrame, target: str, value: str, reference: str) -> DataFrame:
    """Targets whose bag of values differs from the bag of the reference target.

    Every row becomes one count per (value, target) before anything is compared.
    """
    bags = df.groupBy(F.col(target).alias("target"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    wanted = bags.filter(F.col("target") == reference).select("value", F.col("n").alias("wanted"))
    others = bags.filter(F.col("target") != reference)
    matched = others.join(wanted, "value", "left")
    per_target = matched.groupBy("target").agg(
        F.count(F.lit(1)).alias("values"), F.count_if(F.col("n").eqNullSafe(F.col("wanted"))).alias("equal_values")
    )
    size = wanted.agg(F.count(F.lit(1))).scalar()
    joined = per_target.withColumn("reference_values", size)
    differing = F.col("values") - F.col("equal_values")
    absent = F.col("reference_values") - F.col("equal_values")
    return joined.filter((differing > 0) | (absent > 0)).select(
        "target", "values", "equal_values", "reference_values"
    )


def contingency(df: DataFrame, text: str, target: str) -> DataFrame:
    """Cell counts and the rate of each cell within its target.

    Totals come from the cells by a second aggregate, not from a window over a
    whole target.
    """
    kept = df.filter(F.col(text).isNotNull() & F.col(target).isNotNull())
    cells = kept.groupBy(F.col(text).alias("value"), F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("items"))
    totals = cells.groupBy("target").agg(F.sum("items").alias("__total"))
    return cells.join(totals, "target").select("value", "target", "items", share(F.col("items"), F.col("__total")).alias("rate"))


def association(df: DataFrame, text: str, target: str) -> DataFrame:
    """Cramér's V of two columns and the largest rate spread of one value over the targets.

    Chi-square uses only observed cells: n * (sum o^2 / (row * column) - 1), so
    there is no dense value-by-target matrix.
    """
    kept = df.filter(F.col(text).isNotNull() & F.col(target).isNotNull())
    cells = kept.groupBy(F.col(text).alias("value"), F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("o"))
    columns = cells.groupBy("target").agg(F.sum("o").alias("c"))
    joined = cells.join(columns, "target").withColumn("rate", share(F.col("o"), F.col("c")))
    per_value = joined.groupBy("value").agg(
        F.sum("o").alias("r"),
        F.sum(F.col("o") * F.col("o") / F.col("c")).alias("q"),
        F.count(F.lit(1)).alias("seen"),
        F.max("rate").alias("hi"),
        F.min("rate").alias("lo"),
    )
    merged = per_value.withColumn("k", columns.agg(F.count(F.lit(1))).scalar())
    spread = F.col("hi") - F.when(F.col("seen") < F.col("k"), F.lit(0.0)).otherwise(F.col("lo"))
    one = merged.agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.sum(F.col("q") / F.col("r")).alias("s"),
        F.max("k").alias("k"),
        F.max(spread).alias("max_rate_spread"),
    )
    smaller = F.least(F.col("unique_values") - 1, F.col("k") - 1)
    ratio = F.greatest(F.lit(0.0), F.col("s") - 1) / smaller
    v = F.when(smaller > 0, F.sqrt(ratio)).otherwise(F.lit(0.0))
    return one.select("unique_values", v.alias("cramers_v"), "max_rate_spread").withColumn(
        "strong", F.col("cramers_v") >= STRONG_ASSOCIATION
    )


def minimum_schedule(df: DataFrame, keys: Sequence[str], value: str, target: str, targets: int) -> DataFrame:
    """Smallest value over the targets for each position, with a completeness flag (one row per target)."""
    return (
        df.groupBy(*keys)
        .agg(F.min(value).alias("scheduled"), F.countDistinct(target).alias("targets"), F.count(F.lit(1)).alias("rows"))
        .withColumn("complete", (F.col("targets") == targets) & (F.col("rows") == targets))
    )
