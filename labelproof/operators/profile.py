"""Counts, structure and column profiles of any table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.operators.evaluation import share
from labelproof.operators.ranking import value_weights, weighted_quantiles
from labelproof.session import one_row


def _present(df: DataFrame, *columns: str) -> DataFrame:
    """Grouping drops null keys."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def counts_with_entities(df: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Rows and distinct entities per key. One distinct column, so Spark pre-aggregates on (key, entity)."""
    return (
        _present(df, *keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("items"), F.countDistinct(entity).alias("entities"))
    )


def distinct_counts(df: DataFrame, keys: Sequence[str], entity: str, out: str = "entities") -> DataFrame:
    return _present(df, *keys).groupBy(*keys).agg(F.countDistinct(entity).alias(out))


def structure_profile(df: DataFrame, key: str, entity: str, target: str, split: str) -> DataFrame:
    """One row: sizes, uniqueness, overlap, rows per entity and four per-key maps.

    A first aggregate to one row per (entity, target, split) serves every count
    that does not need the item key.
    """
    base = df.groupBy(entity, target, split).agg(F.count(F.lit(1)).alias("__n"))
    per_entity = (
        _present(base, entity)
        .groupBy(entity)
        .agg(F.sum("__n").alias("__n"), F.countDistinct(split).alias("__splits"))
        .agg(
            F.count(F.lit(1)).alias("unique_entities"),
            F.count_if(F.col("__splits") > 1).alias("entity_overlap_count"),
            F.min("__n").alias("items_per_entity_min"),
            F.max("__n").alias("items_per_entity_max"),
        )
    )

    def as_map(column: str, measure: Column, name: str) -> DataFrame:
        rows = _present(base, column).groupBy(column).agg(measure.alias("__m"))
        entry = F.struct(F.col(column).cast("string"), F.col("__m").cast("bigint"))
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))

    totals = df.agg(F.count(F.lit(1)).alias("total_items"), F.countDistinct(key).alias("unique_keys"))
    parts = [
        totals,
        per_entity,
        as_map(target, F.sum("__n"), "items_per_target"),
        as_map(split, F.sum("__n"), "items_per_split"),
        as_map(target, F.countDistinct(entity), "entities_per_target"),
        as_map(split, F.countDistinct(entity), "entities_per_split"),
    ]
    columns = []
    for part in parts:
        row = one_row(part)
        columns += [row.getField(c).alias(c) for c in part.columns]
    return df.sparkSession.range(1).select(*columns)


def min_median_max(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """min, exact median and max per group, long form: one row per (group, metric); NaN counts as no value.

    The ends of all metrics come from one aggregate of the wide rows. For the medians rows of equal values are merged
    per metric before the metrics are put under each other.
    """
    wide = df.select(*group, *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in metrics])
    keys = [*group, "metric"]
    both = [x for m in metrics for x in (F.min(m).alias(f"{m}__min"), F.max(m).alias(f"{m}__max"))]
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}__min").alias("minimum"), F.col(f"{m}__max").alias("maximum")) for m in metrics]
    ends = _present(wide, *group).groupBy(*group).agg(*both).select(*group, F.inline(F.array(*rows)))
    weights = [value_weights(wide, group, m).select(*group, F.lit(m).alias("metric"), F.col(m).alias("v"), "weight") for m in metrics]
    medians = weighted_quantiles(reduce(lambda a, b: a.unionByName(b), weights), keys, "v", [0.5], ["median"])
    return ends.join(medians, keys, "left")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
    return counted.select(key, F.col("__rows").alias("rows"))


def duplicate_groups(df: DataFrame, digest: Column) -> DataFrame:
    """Number of digests shared by several rows, and the rows involved."""
    groups = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_in_groups")
    )


def whole_row_hash(columns: Sequence[str], seed: int = 0) -> Column:
    """Hash of all columns and of which of them are null (the hash alone skips nulls)."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def row_digest(columns: Sequence[str]) -> Column:
    """Two independent hashes of a row: 16 bytes to group by instead of the whole row."""
    return F.struct(whole_row_hash(columns, 1), whole_row_hash(columns, 2))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Occurrences after the first of fully equal rows."""
    groups = df.groupBy(row_digest(df.columns)).agg(F.count(F.lit(1)).alias("__copies"))
    extra = F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("bigint")
    return groups.agg(F.sum("__copies").alias("rows"), extra.alias("duplicate_rows"))


def leaked_entities(df: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities mapped to more than one split."""
    spread = _present(df, entity).groupBy(entity).agg(F.countDistinct(split).alias("__splits"))
    return spread.filter("__splits > 1").select(entity, F.col("__splits").alias("splits"))


def require_no_leakage(df: DataFrame, entity: str, split: str) -> None:
    bad = [r[0] for r in leaked_entities(df, entity, split).orderBy(entity).limit(5).collect()]
    if bad:
        raise AssertionError(f"entities in more than one split: {bad}")


def column_profile(df: DataFrame) -> DataFrame:
    """Type, nulls, null percent and distinct values (null counted) of every column.

    One branch per column: each reads only its own column and aggregates by
    value with a map-side combine, instead of expanding every row once per
    column for a joint distinct count.
    """
    types = dict(df.dtypes)

    def one(column: str) -> DataFrame:
        # long values travel as digests
        values = df.groupBy(row_digest([column]).alias("v"), F.col(column).isNull().alias("blank")).agg(F.count(F.lit(1)).alias("n"))
        return values.agg(
            F.lit(column).alias("column"),
            F.lit(types[column]).alias("dtype"),
            F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).cast("bigint").alias("nulls"),
            F.count(F.lit(1)).alias("distinct_values"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        )

    profile = reduce(lambda a, b: a.unionByName(b), [one(c) for c in df.columns])
    percent = F.coalesce(share(F.col("nulls") * 100, F.col("rows")), F.lit(0.0))
    return profile.withColumn("null_percent", percent).orderBy(F.desc("null_percent"), "column")


def constant_columns(profile: DataFrame) -> DataFrame:
    return profile.filter("distinct_values <= 1").select("column")


def identifier_like(columns: Sequence[str]) -> list[str]:
    """Names that look like identifiers."""
    low = [(c, c.lower()) for c in columns]
    return [c for c, n in low if n == "id" or n.endswith("_id") or n.startswith("id_")]


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent per target value, null kept."""
    counts = df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("target", "count", share(F.col("count") * 100, total).alias("percent"))


def imbalance_status(distribution: DataFrame, minimum_percent: float = 15.0) -> DataFrame:
    """WARN only for exactly two target values with the smaller one under the floor."""
    one = distribution.agg(F.count(F.lit(1)).alias("values"), F.min("percent").alias("smallest_percent"))
    warn = (F.col("values") == 2) & (F.col("smallest_percent") < minimum_percent)
    return one.withColumn("status", F.when(warn, "WARN").otherwise("PASS"))


VALIDATION_NAMES = ("validation", "valid", "val", "test")


def split_side(split: str = "split") -> Column:
    """``train``, ``validation`` (any accepted spelling) or null."""
    label = F.lower(F.col(split).cast("string"))
    return F.when(label == "train", "train").when(label.isin(*VALIDATION_NAMES), "validation")


def target_share_by_side(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Share of each target in train and in validation, 0 where absent."""
    sided = df.withColumn("__side", split_side(split)).filter(F.col("__side").isNotNull() & F.col(target).isNotNull())
    counts = sided.groupBy(F.col(target).alias("target")).agg(
        F.count_if(F.col("__side") == "train").alias("train_rows"),
        F.count_if(F.col("__side") == "validation").alias("validation_rows"),
    )
    totals = one_row(counts.agg(F.sum("train_rows").alias("t"), F.sum("validation_rows").alias("v")))
    zero = F.lit(0.0)
    return counts.select(
        "target",
        F.coalesce(share(F.col("train_rows"), totals.getField("t")), zero).alias("train"),
        F.coalesce(share(F.col("validation_rows"), totals.getField("v")), zero).alias("validation"),
    )


def time_boundary(df: DataFrame, time: str, split: str = "split") -> DataFrame:
    """Last train time, first validation time, and whether train ends strictly before."""
    side = split_side(split)
    one = df.agg(
        F.max(F.when(side == "train", F.col(time))).alias("train_max"),
        F.min(F.when(side == "validation", F.col(time))).alias("validation_min"),
    )
    return one.withColumn("chronological", F.coalesce(F.col("train_max") < F.col("validation_min"), F.lit(True)))


def text_check(df: DataFrame, text: str) -> DataFrame:
    """Empty texts after trimming and exact copies after the first."""
    values = df.select(F.trim(F.coalesce(F.col(text), F.lit(""))).alias("v"))
    # group by a digest so the shuffle carries 32 bytes per text, not the text
    groups = values.groupBy(F.sha2("v", 256).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.first(F.length("v") == 0).alias("is_empty")
    )
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("is_empty"), F.col("n"))), F.lit(0)).cast("bigint").alias("empty_texts"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_texts"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def scale_ratio(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 100.0) -> DataFrame:
    """Largest over smallest non-zero sample deviation of the numeric columns; one pass."""
    names = list(columns or numeric_columns(df))
    one = df.agg(*[F.stddev_samp(c).alias(c) for c in names])
    spread = F.filter(F.array(*[F.col(c) for c in names]), lambda s: s.isNotNull() & (s != 0))
    ratio = F.try_divide(F.array_max(spread), F.array_min(spread))
    return one.select(ratio.alias("scale_ratio")).withColumn(
        "status", F.when(F.col("scale_ratio") > limit, "WARN").otherwise("PASS")
    )


def audit_summary(audit: DataFrame, targets: Sequence[str], *, entity: str, actual: str, listed: str, usable: str) -> DataFrame:
    """Per fixed target: distinct usable entities (by actual target), failed and audited entries (by listed target)."""
    from labelproof.operators.reshape import literals
    from labelproof.operators.rules import is_true_text

    ok = is_true_text(usable)
    good = (
        audit.filter(ok)
        .groupBy(F.col(actual).alias("target"))
        .agg(F.countDistinct(F.nullif(F.col(entity), F.lit(""))).alias("usable_entities"))
    )
    entries = audit.groupBy(F.col(listed).alias("target")).agg(
        F.count_if(~ok).alias("failed_entries"), F.count(F.lit(1)).alias("audited_entries")
    )
    out = literals(audit.sparkSession, targets, "target").join(good, "target", "left").join(entries, "target", "left")
    return out.na.fill(0)


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("checks"))


def gate_decision(results: DataFrame, status: str = "status") -> DataFrame:
    """RED on any FAIL, YELLOW on any WARN or MANUAL, else GREEN."""
    has = lambda *s: F.coalesce(F.bool_or(F.col(status).isin(*s)), F.lit(False))
    decision = F.when(has("FAIL"), "RED").when(has("WARN", "MANUAL"), "YELLOW").otherwise("GREEN")
    return results.agg(decision.alias("decision"), F.count(F.lit(1)).alias("checks"))


