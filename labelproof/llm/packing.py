"""Number arrays as compact bytes, for rows that carry many numbers from task to task."""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray) -> bytes:
    """The array's bytes by significance: the high ones of small numbers are zeros that compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def packed(sorted_numbers: np.ndarray) -> bytes:
    """Sorted numbers as the bytes of their differences."""
    return planes(np.diff(sorted_numbers, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def range_edges(parts: int) -> np.ndarray:
    """Where the range of 64-bit hashes is cut into equal parts."""
    width = (1 << 64) // parts + 1
    return np.array([min(i * width, (1 << 64) - 1) for i in range(1, parts)], np.uint64)
