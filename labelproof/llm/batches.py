"""Bounded Arrow batches for rows that hold whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TEXT_ROWS = 500


def bounded(rows: DataFrame) -> DataFrame:
    """The same rows; the session cuts them into Arrow batches of at most ``TEXT_ROWS`` from now on.

    A batch is held by the executor and by its Python worker at once. The session's default of 10,000 rows is meant
    for numbers; as many texts take hundreds of megabytes.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return rows


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # the C library's, where it has the call
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], clear: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; before and after it the worker gives back memory that is not used.

    Spark keeps Python workers for later tasks, several for each core where plans have several steps in Python. Each
    would hold what its largest task has taken. ``clear`` empties what outlives the run.
    """

    def work(batches):
        give_back()
        yield from run(batches)
        if clear is not None:
            clear()
        give_back()

    return work


def limited(rows: DataFrame, batch_bytes: int = 1 << 26) -> DataFrame:
    """As :func:`bounded`, and a batch also ends at ``batch_bytes``: many very long texts do not meet in one."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    return bounded(rows)
