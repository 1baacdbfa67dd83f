"""Byte-level BPE as a monoid: encodings of neighbouring parts are joined by re-encoding a window at their border.

A word piece is cut in halves down to leaves of a few bytes, leaves are merged directly, and two encodings are joined
on the way up. The join re-encodes a window of tokens around the border and lets it grow until what it yields fits
both neighbours. That is enough for the right result: a sequence of tokens, each of which encodes to itself, is the
encoding of its bytes exactly if every two neighbours, taken alone, encode to themselves. (No merge across a border
is ever the best one in the pair alone, and merges inside two parts come in the same order whether or not other parts
stand beside them.) So a piece of any length takes about n log n steps.

The ranks of the vocabulary are read by the driver and travel to the tasks; they are as large as their file.

Defined cases: a null text encodes as the empty text, to no tokens. Texts are never cut. Repeated rows are encoded one
by one, and other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelproof.llm.batches import bounded, tidy

LEAF = 24
NO_RANK = 1 << 40
CACHED_PIECES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = pattern
        self._prepare()

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def _prepare(self) -> None:
        self._find = regex.compile(self.pattern).findall
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._known = _PieceCache(self)

    def forget(self) -> None:
        """Empties what is kept of pieces seen before."""
        self._pairs.clear()
        self._known.clear()

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of a few bytes: the adjacent pair of lowest rank is merged until there is none."""
        if len(data) > 4 * LEAF:
            return self._merged_by_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        scores = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while scores:
            best = min(scores)
            if best == NO_RANK:
                break
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], NO_RANK)
        return parts

    def _merged_by_heap(self, data: bytes) -> list[bytes]:
        """The same for windows that have grown long: pairs wait in a heap, parts are linked by their places."""
        n = len(data)
        rank = self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0 where none starts
        before = list(range(-1, n - 1))
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            middle = end[i]
            # outdated where either part has changed meanwhile
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(waiting, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(data[p:stop])) is not None:
                heapq.heappush(waiting, (r, p, stop))
        return [data[i : end[i]] for i in range(n) if end[i]]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens side by side stay as they are."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = self.merged(left + right) == [left, right]
            if len(self._pairs) > CACHED_PIECES:
                self._pairs.clear()
        return known

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two parts together."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            middle = self.merged(b"".join(left[-i:] + right[:j]))
            left_holds = i == len(left) or self.fits(left[-i - 1], middle[0])
            right_holds = j == len(right) or self.fits(middle[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + middle + right[j:]
            if not left_holds:
                i = min(2 * i, len(left))
            if not right_holds:
                j = min(2 * j, len(right))

    def tokens(self, data: bytes) -> list[bytes]:
        """Tree reduction over the halves of one piece."""
        if len(data) <= LEAF:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self.tokens(data[:middle]), self.tokens(data[middle:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else [self.ranks[t] for t in self.tokens(piece)]

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text; pieces of the pattern never merge with each other."""
        return list(chain.from_iterable(map(self._known.__getitem__, self._find(text))))


class _PieceCache(dict):
    """Encodings of short pieces seen before, emptied when it has grown to its bound."""

    def __init__(self, encoder: BytePairEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encoder.encode_piece(piece.encode())
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def concatenated(parts: list[bytes]) -> bytes:
    """The bytes of many tokens, neighbours joined level by level."""
    parts = [b"".join(parts[i : i + 256]) for i in range(0, len(parts), 256)]
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def _encoded_column(texts: pa.Array, encoder: BytePairEncoder) -> pa.ListArray:
    # long texts: ids leave Python lists text by text
    found = [np.array(encoder.encode(t) if t else [], np.int32) for t in texts.to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in found])))
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _decoded_column(lists: pa.ListArray, table: dict[int, bytes]) -> pa.Array:
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
    values = [concatenated(list(map(table.__getitem__, flat[a:b].tolist()))) for a, b in zip(offsets, offsets[1:])]
    return pa.array(values, pa.binary())


def encoded(docs: DataFrame, keys: list[str], text: str, encoder: BytePairEncoder, ids: str = "ids") -> DataFrame:
    """(keys, ids) per row: the token ids of its text, array<int>."""
    rows = bounded(docs.select(text, *keys))
    out = T.StructType([*(docs.schema[k] for k in keys), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for batch in batches:
            lists = _encoded_column(batch.column(0), encoder)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], [*keys, ids])

    return rows.mapInArrow(tidy(run, encoder.forget), out)


def decoded(rows: DataFrame, keys: list[str], ids: str, ranks: dict[bytes, int], out: str = "decoded") -> DataFrame:
    """(keys, ids, out) per row: the bytes behind its token ids; null ids give no bytes."""
    fields = [*(rows.schema[k] for k in keys), rows.schema[ids], T.StructField(out, T.BinaryType())]
    table = {rank: token for token, rank in ranks.items()}

    def run(batches):
        for batch in batches:
            values = _decoded_column(batch.column(len(keys)), table)
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*keys, ids, out])

    return bounded(rows.select(*keys, ids)).mapInArrow(tidy(run), T.StructType(fields))


def round_trip(
    docs: DataFrame, keys: list[str], text: str, encoder: BytePairEncoder, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """(keys, ids, out) per row: the token ids of its text, and the bytes behind those ids.

    As :func:`decoded` of :func:`encoded`, in one step: two steps take two Python workers for each core, which an
    executor keeps, each with the vocabulary.
    """
    rows = bounded(docs.select(text, *keys))
    fields = [
        *(docs.schema[k] for k in keys),
        T.StructField(ids, T.ArrayType(T.IntegerType(), False)),
        T.StructField(out, T.BinaryType()),
    ]

    def run(batches):
        table = {rank: token for token, rank in encoder.ranks.items()}
        for batch in batches:
            lists = _encoded_column(batch.column(0), encoder)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, _decoded_column(lists, table)], [*keys, ids, out])

    return rows.mapInArrow(tidy(run, encoder.forget), T.StructType(fields))
