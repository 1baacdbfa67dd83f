"""Joins between manifests, listings, lookups and prediction runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions.vectors import max_abs_difference
from labelproof.operators.reshape import set_difference


def assignment_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct assignments found in one table only, labelled by side."""
    return set_difference(left.select(*columns), right.select(*columns), "left", "right")


def missing_references(listed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Listed rows whose key does not exist."""
    return listed.join(existing.select(key).distinct(), key, "left_anti")


def missing_summary(listed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Number of missing references and the first one."""
    return missing_references(listed, existing, key).agg(
        F.count(F.lit(1)).alias("missing"), F.min(key).alias("first_missing")
    )


def listing_difference(on_disk: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``on_disk`` (not listed) or ``listed`` (not on disk)."""
    return set_difference(on_disk.select(key), listed.select(key), "on_disk", "listed")


def shared_groups(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Distinct non-null groups on both sides of a boundary."""
    a = left.select(group).filter(F.col(group).isNotNull()).distinct()
    b = right.select(group).filter(F.col(group).isNotNull()).distinct()
    return a.join(b, group, "left_semi")


def listed_items(df: DataFrame, column: str, out: str, separator: str = ";") -> DataFrame:
    """Explode a separated list into trimmed, non-blank entries."""
    parts = F.transform(F.split(F.col(column), separator), lambda x: F.trim(x))
    return df.withColumn(out, F.explode(F.filter(parts, lambda x: x != "")))


def compare_runs(
    left: DataFrame, right: DataFrame, key: str, probabilities: str, exact: Sequence[str], tolerance: float
) -> DataFrame:
    """Per item of either run: largest probability difference, exact-field agreement, PASS or FAIL.

    An item that one run lacks fails, with ``missing_in`` telling which.
    """
    other = right.select(key, F.lit(True).alias("__right"), *[F.col(c).alias(f"__other_{c}") for c in (probabilities, *exact)])
    joined = left.withColumn("__left", F.lit(True)).join(other, key, "full_outer")
    lacking = F.when(F.col("__left").isNull(), "left").when(F.col("__right").isNull(), "right").otherwise("")
    same = [F.col(c).eqNullSafe(F.col(f"__other_{c}")).alias(f"same_{c}") for c in exact]
    gap = max_abs_difference(F.col(probabilities), F.col(f"__other_{probabilities}"))
    checked = joined.select(key, lacking.alias("missing_in"), gap.alias("max_abs_difference"), *same)
    agree = F.col("missing_in") == ""
    for c in exact:
        agree = agree & F.col(f"same_{c}")
    passed = F.coalesce(agree & (F.col("max_abs_difference") <= tolerance), F.lit(False))
    return checked.withColumn("status", F.when(passed, "PASS").otherwise("FAIL"))


def keyword_matrix(documents: DataFrame, key: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """One row per document and configured keyword: PASS when the text holds it, else WARN.

    The text is lower-cased once and stays on its row; only the short result is
    exploded, one entry per keyword of the fixed list.
    """
    low = F.lower(F.col(text))
    hits = F.array(
        *[F.struct(F.lit(k).alias("keyword"), F.coalesce(low.contains(k.lower()), F.lit(False)).alias("found")) for k in keywords]
    )
    rows = documents.select(key, F.inline(hits))
    return rows.select(key, "keyword", F.when(F.col("found"), "PASS").otherwise("WARN").alias("status"))


def lookup_constant(column: Column, table: dict[str, str], unknown: str = "") -> Column:
    """Value from a small constant map, a default for unknown keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(unknown))
