"""Row rules: filters, ordered rule chains, admission and decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the admission rules.
MAX_BYTES = 4 * 1024 * 1024
MAX_PIXELS = 20_000_000
MIN_SIDE = 20
MAX_SIDE = 6000
BLANK_STD = 2.0
FLAT_RANGE = 5.0
FLAT_STD = 5.0
LOW_CONTRAST_STD = 5.0
LOW_CONTRAST_RANGE = 10.0
SUPPORTED_TYPES = ("image/jpeg", "image/png")


@dataclass(frozen=True)
class Rule:
    """A failure condition with the reason to report; a null condition counts as not failed."""

    failed: Column
    reason: Column | str

    def outcome(self) -> Column:
        reason = F.lit(self.reason) if isinstance(self.reason, str) else self.reason
        return F.when(self.failed, reason)


def first_failure(df: DataFrame, rules: Sequence[Rule], *, usable: str = "usable", reason: str = "reason") -> DataFrame:
    """Apply rules in order; a row keeps the reason of the first one it breaks."""
    broken = F.coalesce(*[r.outcome() for r in rules]) if rules else F.lit(None).cast("string")
    return df.withColumn(reason, F.coalesce(broken, F.lit(""))).withColumn(usable, F.col(reason) == "")


def is_true_text(column: str) -> Column:
    """``true`` or ``1`` in any case, whatever the column type."""
    return F.coalesce(F.lower(F.col(column).cast("string")).isin("true", "1"), F.lit(False))


def trimmed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns})


def blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a blank in any required column, with the names of those columns."""
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in columns]))
    return trimmed(df, columns).withColumn("blank_columns", F.array_join(missing, ",")).filter("blank_columns <> ''")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def unexpected_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Distinct values outside the allowed list, with row counts."""
    outside = ~F.col(column).isin(*allowed) | F.col(column).isNull()
    return df.filter(outside).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def values_missing_from(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``df`` that never occur in ``reference``."""
    known = reference.select(column).distinct()
    return df.select(column).distinct().join(known, column, "left_anti")


def one_split(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.filter(F.col(split) == label)


def allowed_splits(df: DataFrame, labels: Sequence[str], split: str = "split") -> DataFrame:
    """Only rows of the allowed splits; the filter reaches the scan."""
    return df.filter(F.col(split).isin(*labels))


def require_splits(df: DataFrame, labels: Sequence[str], split: str = "split") -> DataFrame:
    """Restrict to the allowed splits and raise when one of them holds no row."""
    kept = allowed_splits(df, labels, split)
    present = {r[0] for r in kept.groupBy(split).count().select(split).collect()}
    missing = sorted(set(labels) - present)
    if missing:
        raise ValueError(f"splits without rows: {missing}")
    return kept


EFFECT_FLAGS = (
    "dark_background",
    "soft_contrast",
    "blur_applied",
    "jpeg_applied",
    "letter_spacing_applied",
    "rotation_applied",
    "horizontal_shift_applied",
    "vertical_shift_applied",
    "scaling_applied",
)


def effect_flags() -> dict[str, Column]:
    """Null-aware flags over the effect fields."""

    def differs(name: str, neutral) -> Column:
        return F.coalesce(F.col(name) != F.lit(neutral), F.lit(True))

    return {
        "dark_background": F.coalesce(F.col("background") == "dark", F.lit(False)),
        "soft_contrast": F.coalesce(F.col("contrast_style") == "soft", F.lit(False)),
        "blur_applied": F.col("blur_radius").isNotNull(),
        "jpeg_applied": F.col("jpeg_quality").isNotNull(),
        "letter_spacing_applied": differs("letter_spacing_px", 0),
        "rotation_applied": F.coalesce(F.abs("rotation_degrees") > 0, F.lit(False)),
        "horizontal_shift_applied": differs("horizontal_shift_px", 0),
        "vertical_shift_applied": differs("vertical_shift_px", 0),
        "scaling_applied": differs("scale_factor", 1.0),
    }


def quality_flags(metrics: DataFrame, width: int, height: int) -> DataFrame:
    """Blank, low contrast, wrong size, missing and corrupt flags of measured items."""
    opened = F.col("opens_successfully")
    return metrics.withColumns(
        {
            "blank": F.when(opened, F.col("intensity_range") == 0),
            "low_pixel_contrast": F.when(
                opened, (F.col("contrast_std") < LOW_CONTRAST_STD) | (F.col("intensity_range") < LOW_CONTRAST_RANGE)
            ),
            "wrong_size": F.when(opened, (F.col("width") != width) | (F.col("height") != height)),
            "missing": ~F.col("exists"),
            "corrupt": F.col("exists") & ~opened,
        }
    )


def quality_counts(flagged: DataFrame) -> DataFrame:
    names = ("missing", "corrupt", "blank", "low_pixel_contrast", "wrong_size")
    return flagged.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("opens_successfully").alias("opened"),
        *[F.count_if(n).alias(n) for n in names],
    )


def admission_rules(*, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS) -> list[Rule]:
    """Ordered admission rules over measured inputs.

    Columns: ``content_type``, ``length``, ``width``, ``height``, ``std``,
    ``p01``, ``p99``; null sizes mean the payload could not be decoded.
    """
    w, h, std = F.col("width"), F.col("height"), F.col("std")
    flat = (F.col("p99") - F.col("p01") < FLAT_RANGE) & (std < FLAT_STD)
    return [
        Rule(~F.coalesce(F.col("content_type").isin(*SUPPORTED_TYPES), F.lit(False)), "unsupported type"),
        Rule(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty input"),
        Rule(F.col("length") > max_bytes, "too many bytes"),
        Rule(w.isNull() | h.isNull() | (w < 0), "unreadable"),
        Rule(w.cast("bigint") * h > max_pixels, "too many pixels"),
        Rule((w < MIN_SIDE) | (h < MIN_SIDE), "too small"),
        Rule((w > MAX_SIDE) | (h > MAX_SIDE), "too large"),
        Rule((std < BLANK_STD) | flat, "blank or nearly blank"),
    ]


def decide(df: DataFrame, threshold: float, confidence: str = "confidence") -> DataFrame:
    """Accept confident rows; others keep label and probabilities but carry a warning."""
    accepted = F.coalesce((F.col(confidence) >= F.lit(float(threshold))) & ~F.isnan(F.col(confidence).cast("double")), F.lit(False))
    return df.withColumns(
        {
            "accepted": accepted,
            "uncertain": ~accepted,
            "warning": F.when(accepted, "").otherwise("low confidence: treat as an uncertain first guess"),
        }
    )


def prediction_frame(
    df: DataFrame, keys: Sequence[str], classes: Sequence[str], *, truth: str = "truth", probabilities: str = "probabilities"
) -> DataFrame:
    """Keys, truth, predicted label, confidence, correctness and one probability column per class."""
    from labelproof.functions.vectors import argmax_label

    p = F.col(probabilities)
    return df.withColumn("predicted", argmax_label(probabilities, classes)).select(
        *keys,
        truth,
        "predicted",
        F.array_max(p).alias("confidence"),
        (F.col(truth) == F.col("predicted")).alias("correct"),
        *[F.element_at(p, i + 1).alias(f"probability_{c}") for i, c in enumerate(classes)],
    )


def inventory_lint(
    files: DataFrame, required: Sequence[str], markers: Sequence[str], suffix_rules: Sequence[str] = (), name: str = "name"
) -> DataFrame:
    """Findings over a file list: required names absent, names with a forbidden marker or suffix.

    ``suffix_rules`` are regular expressions on the lower-cased name.
    """
    from labelproof.operators.reshape import literals

    wanted = literals(files.sparkSession, required, name)
    missing = wanted.join(files.select(name).distinct(), name, "left_anti").withColumn("finding", F.lit("missing"))
    low = F.lower(name)
    bad = F.lit(False)
    for marker in markers:
        bad = bad | low.contains(marker)
    for pattern in suffix_rules:
        bad = bad | low.rlike(pattern)
    forbidden = files.filter(bad).select(name).withColumn("finding", F.lit("forbidden"))
    return missing.unionByName(forbidden)
