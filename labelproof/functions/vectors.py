"""Expressions over numeric arrays: probabilities, difference hashes, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_label(probabilities: str | Column, classes: Sequence) -> Column:
    """Label at the first maximum."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(scores: Column) -> Column:
    """Softmax, shifted by the maximum so large scores do not overflow."""
    # maximum and total are bound as lambda variables, so each is worked out once per array
    highest = F.array(F.array_max(scores).cast("double"))
    shifted = F.transform(highest, lambda top: F.transform(scores, lambda x: F.exp(x.cast("double") - top)))[0]
    totals = F.transform(F.array(shifted), lambda e: F.struct(e.alias("e"), array_sum(e).alias("total")))
    return F.transform(totals, lambda s: F.transform(s["e"], lambda x: x / s["total"]))[0]


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def probability_problem(probabilities: Column, label: Column, classes: Sequence, tolerance: float = 1e-6) -> Column:
    """Why a probability array is invalid; empty text when it is valid."""
    return (
        F.when(F.coalesce(F.size(probabilities), F.lit(-1)) != len(classes), "wrong length")
        .when(~F.forall(probabilities, finite), "not finite")
        .when(F.abs(array_sum(probabilities) - 1) > tolerance, "sum is not one")
        .when(~label.eqNullSafe(argmax_label(probabilities, classes)), "label is not the argmax")
        .otherwise("")
    )


def difference_bits(values: Column, first: int, count: int) -> Column:
    """Bits ``values[i+1] >= values[i]`` for ``count`` neighbours from ``first`` (0-based), most significant first."""
    steps = F.sequence(F.lit(first + 1), F.lit(first + count))
    return F.aggregate(
        steps,
        F.lit(0).cast("bigint"),
        lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(
            F.when(F.element_at(values, i + 1) >= F.element_at(values, i), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        ),
    )


def difference_hash(values: Column, bits: int, band_bits: int = 64) -> Column:
    """Difference hash of an array of ``bits + 1`` numbers as BIGINT bands."""
    return F.array(*[difference_bits(values, s, min(band_bits, bits - s)) for s in range(0, bits, band_bits)])


def hash_hex(bands: Column, bands_count: int) -> Column:
    """Fixed-width hexadecimal text of 64-bit bands."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.element_at(bands, i + 1))), 16, "0") for i in range(bands_count)])


def hamming(left: Column, right: Column) -> Column:
    """Differing bits between two band arrays."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def max_abs_difference(left: Column, right: Column) -> Column:
    return F.array_max(F.zip_with(left, right, lambda a, b: F.abs(a - b)))
