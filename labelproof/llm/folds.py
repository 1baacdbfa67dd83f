"""Folds of rows that depend on the key alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
