"""Pixel work inside tasks: decoded images in, arrays and numbers out (numpy, Arrow batches)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from labelproof.functions.headers import picture_facts

# Fixed grey conversion weights (fixed point, 16 bits).
GREY_WEIGHTS = {"red": 19595, "green": 38470, "blue": 7471}


def grey(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey image from interleaved bytes in BGR(A) or single-channel order."""
    raw = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return raw[:, :, 0]
    b, g, r = (raw[:, :, i].astype(np.uint32) for i in range(3))
    w = GREY_WEIGHTS
    return ((w["red"] * r + w["green"] * g + w["blue"] * b + 32768) >> 16).astype(np.uint8)


def fit(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Centre-crop to the wanted aspect ratio, then resize with a windowed-sinc filter; levels stay whole, 0 to 255."""
    h, w = image.shape
    scale = min(w / width, h / height)
    cw, ch = scale * width, scale * height
    across = _levels(image.astype(np.float64) @ _weights(w, width, (w - cw) / 2, cw, "lanczos").T, image)
    return _levels(_weights(h, height, (h - ch) / 2, ch, "lanczos") @ across, image)


def stretch(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The whole image resized with a triangle filter, whatever its aspect ratio."""
    h, w = image.shape
    if (w, h) == (width, height):
        return image.astype(np.float64)  # the weights are those of no change
    across = _levels(image.astype(np.float64) @ _weights(w, width, 0.0, w, "triangle").T, image)
    return _levels(_weights(h, height, 0.0, h, "triangle") @ across, image)


def _levels(values: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Whole levels in the range of the picture's kind: 8 bits, or what a deeper picture reaches."""
    return np.clip(np.floor(values + 0.5), 0, max(255, image.max()))


KERNELS = {
    "triangle": (1.0, lambda x: np.maximum(0.0, 1.0 - np.abs(x))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)),
}
# resize weights of the sizes seen by this worker; pictures of a set have few sizes
_KNOWN_WEIGHTS: dict[tuple, np.ndarray] = {}


def _weights(n: int, size: int, start: float, extent: float, kernel: str) -> np.ndarray:
    """Weights (size x n) of a resize along one axis; the filter widens with the shrink factor."""
    key = (n, size, start, extent, kernel)
    if key not in _KNOWN_WEIGHTS:
        step = extent / size
        reach, shape = KERNELS[kernel]
        centres = start + (np.arange(size) + 0.5) * step
        away = (np.arange(n)[None, :] + 0.5 - centres[:, None]) / max(step, 1.0)
        weights = np.where(np.abs(away) <= reach, shape(away), 0.0)
        if len(_KNOWN_WEIGHTS) > 64:
            _KNOWN_WEIGHTS.clear()
        _KNOWN_WEIGHTS[key] = weights / weights.sum(axis=1, keepdims=True)
    return _KNOWN_WEIGHTS[key]


UPRIGHT = T.StructType(
    [T.StructField("pixels", T.BinaryType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType())]
)


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """A picture (rows first) turned and mirrored as its stated orientation asks."""
    if orientation >= 5:
        image = image.swapaxes(0, 1)
    # the corner that is stored first belongs top left, top right, bottom right or bottom left
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image


@F.pandas_udf(UPRIGHT)
def _turned(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, orientation: pd.Series) -> pd.DataFrame:
    rows = []
    for p, h, w, c, o in zip(pixels, height, width, channels, orientation):
        if p is None or pd.isna(h) or pd.isna(o):
            rows.append((None, None, None))
            continue
        image = upright(np.frombuffer(p, np.uint8).reshape(int(h), int(w), int(c)), int(o))
        rows.append((image.tobytes(), *image.shape[:2]))
    kinds = ("object", "Int32", "Int32")
    return pd.DataFrame({f: pd.Series([r[i] for r in rows], dtype=k) for i, (f, k) in enumerate(zip(UPRIGHT.names, kinds))})


def turned() -> Column:
    """Pixels, height and width of a decoded picture after its ``orientation``."""
    return _turned(*[F.col(c) for c in ("pixels", "height", "width", "channels", "orientation")])


STATS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("mean", "std", "minimum", "maximum", "intensity_range", "p01", "p99")]
)


def percentiles(levels: np.ndarray, shares: Sequence[float]) -> list[float]:
    """As ``numpy.percentile`` has them, of whole levels: those are sorted as bytes, and the call costs more than that."""
    ordered = np.sort(levels, axis=None)
    out = []
    for share in shares:
        at = (len(ordered) - 1) * (share / 100)
        k = int(at)
        low, high, part = float(ordered[k]), float(ordered[min(k + 1, len(ordered) - 1)]), at - k
        out.append(high - (high - low) * (1 - part) if part >= 0.5 else low + (high - low) * part)
    return out


@F.pandas_udf(STATS)
def _stats(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    rows = []
    for p, h, w, c in zip(pixels, height, width, channels):
        if p is None or pd.isna(h):
            rows.append([None] * 7)
            continue
        levels = grey(p, int(h), int(w), int(c))
        g = levels.astype(np.float64)
        low, high = percentiles(levels, [1, 99])
        rows.append([g.mean(), g.std(), g.min(), g.max(), g.max() - g.min(), low, high])
    return pd.DataFrame(rows, columns=STATS.names, dtype="float64")


def pixel_stats(pixels: str = "pixels", height: str = "height", width: str = "width", channels: str = "channels") -> Column:
    """Mean, population deviation, extremes, range, 1st and 99th percentile of the grey image."""
    return _stats(F.col(pixels), F.col(height), F.col(width), F.col(channels))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _image_hash(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    out = []
    for p, h, w, c in zip(pixels, height, width, channels):
        if p is None or pd.isna(h):
            out.append(None)
            continue
        small = np.rint(fit(grey(p, int(h), int(w), int(c)), 17, 16))
        bits = (small[:, 1:] >= small[:, :-1]).ravel()
        out.append(np.packbits(bits).view(">i8").astype(np.int64).tolist())
    return pd.Series(out)


def image_hash(pixels: str = "pixels", height: str = "height", width: str = "width", channels: str = "channels") -> Column:
    """256-bit difference hash of the 17x16 grey image as four BIGINT bands."""
    return _image_hash(F.col(pixels), F.col(height), F.col(width), F.col(channels))


# values that a batch of scaled pictures holds at most, if more than one picture is in it
VALUES = 1 << 22


def normalised(df: DataFrame, key: str, width: int, height: int, keep: Sequence[str] = ()) -> DataFrame:
    """Grey image stretched to a size and scaled to -1..1, row by row, as an array of floats; ``keep`` passes through."""

    size, most = width * height, max(1, VALUES // (width * height))
    names = [key, *keep]

    # as Arrow lists: by way of pandas every value becomes a Python object
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                b = batch.slice(start, most)
                values = np.empty((b.num_rows, size), np.float32)
                parts = (b.column(n).to_pylist() for n in ("pixels", "height", "width", "channels"))
                for i, (p, h, w, c) in enumerate(zip(*parts)):
                    values[i] = ((stretch(grey(p, h, w, c), width, height) / 255.0 - 0.5) / 0.5).ravel()
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size, pa.int32())
                tensor = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), tensor], [*names, "tensor"])

    kept = df.filter("decoded").select(*dict.fromkeys([key, *keep, "pixels", "height", "width", "channels"]))
    fields = [*(df.schema[c] for c in (key, *keep)), T.StructField("tensor", T.ArrayType(T.FloatType()))]
    return kept.mapInArrow(work, T.StructType(fields))


# parts of one grey level in which the strength of a gradient is counted
STRENGTH_PARTS = 256


def cell_counts(image: np.ndarray, cell: tuple[int, int], bins: int = 9) -> np.ndarray:
    """Gradient strength by cell and unsigned angle (row, column, bin), in whole ``STRENGTH_PARTS`` of a level.

    Levels and so gradients are whole numbers, and a strength is rounded down before it is added: sums are exact and
    do not depend on their order.
    """
    levels = image.astype(np.int64)
    gy, gx = np.zeros_like(levels), np.zeros_like(levels)
    gy[1:-1, :] = levels[2:, :] - levels[:-2, :]
    gx[:, 1:-1] = levels[:, 2:] - levels[:, :-2]
    cw, ch = cell
    rows, columns = levels.shape[0] // ch, levels.shape[1] // cw
    # what is left over beside the last whole cell counts in none
    gy, gx = gy[: rows * ch, : columns * cw], gx[: rows * ch, : columns * cw]
    strength = np.floor(STRENGTH_PARTS * np.sqrt(gx * gx + gy * gy))
    sector = (np.degrees(np.arctan2(gy, gx)) % 180.0 // (180.0 / bins)).astype(int) % bins
    place = (np.arange(rows * ch)[:, None] // ch * columns + np.arange(columns * cw) // cw) * bins + sector
    found = np.bincount(place.ravel(), weights=strength.ravel(), minlength=rows * columns * bins)
    return found.astype(np.int64).reshape(rows, columns, bins)


def orientation_histogram(image: np.ndarray, cell: tuple[int, int], bins: int = 9, block: int = 2) -> np.ndarray:
    """Histogram-of-gradients vector of a picture of whole levels: cell counts in blocks, normalised twice, clipped at 0.2."""
    cw, ch = cell
    cells = cell_counts(image, cell, bins) / (STRENGTH_PARTS * 255.0 * cw * ch)
    rows, cols = cells.shape[:2]
    windows = np.lib.stride_tricks.sliding_window_view(cells, (block, block), axis=(0, 1))
    vectors = np.moveaxis(windows, 2, -1).reshape(rows - block + 1, cols - block + 1, -1)

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.sqrt((v**2).sum(axis=-1, keepdims=True) + 1e-10)

    return unit(np.minimum(unit(vectors), 0.2)).ravel().astype(np.float32)


def described(df: DataFrame, keep: list[str], name: str, kind: T.DataType, vector: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keep`` and the ``vector`` of each decoded grey image as an array of ``kind``.

    A vector may be many times as large as its picture, so what leaves a task is cut by the number of values, not of rows.
    """
    values = to_arrow_type(kind)

    def piece(batch: pa.RecordBatch, vectors: list[np.ndarray]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *map(len, vectors)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(vectors), values))
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), lists], [*keep, name])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, start, size = [], 0, 0
            for i, picture in enumerate(zip(*(batch.column(n) for n in ("pixels", "height", "width", "channels")))):
                vectors.append(vector(grey(*(x.as_py() for x in picture))))
                size += len(vectors[-1])
                if size >= VALUES or i + 1 == batch.num_rows:
                    yield piece(batch.slice(start, len(vectors)), vectors)
                    vectors, start, size = [], i + 1, 0

    columns = list(dict.fromkeys([*keep, "pixels", "height", "width", "channels"]))
    fields = [df.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(kind))]
    return df.filter("decoded").select(*columns).mapInArrow(work, T.StructType(fields))


def gradient_features(df: DataFrame, keep: list[str], width: int, height: int, cell: tuple[int, int] = (8, 8)) -> DataFrame:
    """Orientation-histogram features of decoded images; other columns in ``keep`` pass through."""

    def vector(image: np.ndarray) -> np.ndarray:
        return orientation_histogram(fit(image, width, height), cell)

    return described(df, keep, "features", T.FloatType(), vector)


def cell_histograms(df: DataFrame, keep: list[str], cell: tuple[int, int] = (8, 8)) -> DataFrame:
    """Cell counts of decoded images at their own size, flattened row by row; ``keep`` passes through."""
    return described(df, keep, "counts", T.LongType(), lambda image: cell_counts(image, cell).ravel())


def gradient_column(picture: str, width: int, height: int, cell: tuple[int, int] = (8, 8)) -> Column:
    """Orientation-histogram features of a picture struct (pixels, height, width, channels)."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def work(pixels: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        rows = zip(pixels, h, w, c)
        return pd.Series([orientation_histogram(fit(grey(p, *map(int, s)), width, height), cell) for p, *s in rows])

    return work(*[F.col(f"{picture}.{n}") for n in ("pixels", "height", "width", "channels")])


def structural_similarity(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two grey images over sliding windows (sample covariance, 8-bit range)."""
    x, y = a.astype(np.float64), b.astype(np.float64)

    def mean(z: np.ndarray) -> np.ndarray:
        s = np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        k = window
        return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)

    ux, uy = mean(x), mean(y)
    n = window * window / (window * window - 1)
    vx, vy, vxy = n * (mean(x * x) - ux * ux), n * (mean(y * y) - uy * uy), n * (mean(x * y) - ux * uy)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux**2 + uy**2 + c1) * (vx + vy + c2))).mean())


@F.pandas_udf(T.DoubleType())
def _similarity(
    lp: pd.Series, lh: pd.Series, lw: pd.Series, lc: pd.Series, rp: pd.Series, rh: pd.Series, rw: pd.Series, rc: pd.Series
) -> pd.Series:
    out = []
    for a, ah, aw, ac, b, bh, bw, bc in zip(lp, lh, lw, lc, rp, rh, rw, rc):
        out.append(structural_similarity(grey(a, ah, aw, ac), grey(b, bh, bw, bc)) if (ah, aw) == (bh, bw) else None)
    return pd.Series(out, dtype="float64")


def image_similarity(left: str, right: str) -> Column:
    """Structural similarity of two image structs; null when their shapes differ."""
    parts = [F.col(f"{s}.{n}") for s in (left, right) for n in ("pixels", "height", "width", "channels")]
    return _similarity(*parts)


def png_bytes(image: np.ndarray, orientation: int | None = None) -> bytes:
    """A grey (2-D) or RGB (3-D) array as PNG, with a stated orientation where one is given."""
    height, width = image.shape[:2]
    colour = 0 if image.ndim == 2 else 2
    raw = b"".join(b"\x00" + row.tobytes() for row in np.ascontiguousarray(image, dtype=np.uint8))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    stated = b""
    if orientation is not None:
        # one directory of one entry: the orientation as a short number
        directory = struct.pack(">HHHIHHI", 1, 0x0112, 3, 1, orientation, 0, 0)
        stated = chunk(b"eXIf", b"MM" + struct.pack(">HI", 42, 8) + directory)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + stated + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def tile_png(levels: Column, side: int, scale: int) -> Column:
    """PNG of ``side`` x ``side`` grey levels, every level a ``scale`` x ``scale`` tile."""

    @F.pandas_udf(T.BinaryType())
    def draw(values: pd.Series) -> pd.Series:
        tile = np.ones((scale, scale), dtype=np.uint8)
        return values.map(lambda v: png_bytes(np.kron(np.asarray(v, dtype=np.uint8).reshape(side, side), tile)))

    return draw(levels)


# Chunks that say nothing about the values of pixels.
PLAIN_CHUNKS = (b"IHDR", b"IDAT", b"IEND", b"eXIf", b"pHYs", b"tEXt", b"tIME")
# decoded bytes that a batch of pictures holds, about
PIECE = 32 << 20


def plain_png(data: bytes | None) -> np.ndarray | None:
    """The pixels (rows, columns, channels in BGR order) of a whole grey or RGB PNG of 8 bits; None for any other data.

    Not interlaced, sums right, rows stored as they are or as differences to the left or above: numpy undoes these at
    once. All else, damaged files too, is left to a full decoder.
    """
    if data is None or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    chunks, at = [], 8
    while at + 12 <= len(data) and (not chunks or chunks[-1][0] != b"IEND"):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if kind not in PLAIN_CHUNKS or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            return None
        chunks.append((kind, body))
        at += size + 12
    kinds = [k for k, _ in chunks]
    if kinds[:1] != [b"IHDR"] or kinds.count(b"IHDR") > 1 or kinds[-1] != b"IEND" or len(chunks[0][1]) != 13:
        return None
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    if depth != 8 or colour not in (0, 2) or any(rest) or not (width and height):
        return None
    channels = 1 if colour == 0 else 3
    wanted = height * (1 + width * channels)
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(b for k, b in chunks if k == b"IDAT"), wanted + 1)
    except zlib.error:
        return None
    if len(raw) != wanted or not unpacker.eof:
        return None
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * channels)
    filters, image = rows[:, 0], rows[:, 1:].reshape(height, width, channels).copy()
    if filters.max() > 2:
        return None
    left = filters == 1
    if left.any():
        image[left] = np.add.accumulate(image[left], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(filters[1:] == 2) + 1:
        image[y] += image[y - 1]
    return image if channels == 1 else image[:, :, ::-1]


def plain_pictures(df: DataFrame, keep: list[str], content: str = "content", *, turn: bool = True, most: int | None = None) -> DataFrame:
    """``keep``, orientation and the picture (width, height, channels, pixels) of plain PNG contents; other contents stay as bytes.

    A row has either a width or content, or neither where it had no content. With ``turn`` a picture is turned as it
    states; pixels of more than ``most`` bytes are left out, their sizes stay.
    """
    fields = [T.StructField(n, T.IntegerType()) for n in ("orientation", "width", "height", "channels")]
    fields += [T.StructField("pixels", T.BinaryType()), T.StructField(content, T.BinaryType())]

    def piece(batch: pa.RecordBatch, turns: list, found: list) -> pa.RecordBatch:
        sizes = [(None, None, None) if p is None else p.shape for p in found]
        bodies = [c if p is None else None for c, p in zip(batch.column(content).to_pylist(), found)]
        columns = [pa.array(turns, pa.int32()), *(pa.array([s[i] for s in sizes], pa.int32()) for i in (1, 0, 2))]
        held = [None if p is None or (most is not None and p.nbytes > most) else p.tobytes() for p in found]
        columns.append(pa.array(held, pa.binary()))
        kept = [batch.column(c) for c in keep]
        names = [*keep, "orientation", "width", "height", "channels", "pixels", content]
        return pa.RecordBatch.from_arrays([*kept, *columns, pa.array(bodies, pa.binary())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, found, start, size = [], [], 0, 0
            for i, value in enumerate(batch.column(content)):
                data = value.as_py()
                image, orientation = plain_png(data), picture_facts(data)[3]
                turns.append(orientation)
                found.append(upright(image, orientation) if turn and image is not None else image)
                size += 0 if image is None else image.nbytes
                if size >= PIECE or i + 1 == batch.num_rows:
                    yield piece(batch.slice(start, len(found)), turns, found)
                    turns, found, start, size = [], [], i + 1, 0

    return df.select(*keep, content).mapInArrow(work, T.StructType([*(df.schema[c] for c in keep), *fields]))
