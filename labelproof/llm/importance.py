"""Importance resampling: documents drawn by how much more often their word runs occur in a target than in the corpus.

Features of a text are its runs of 1 to ``longest`` consecutive words, hashed to ``buckets``. Both corpora are counted
into arrays of that length; the log ratio of the smoothed counts, in thousandths and rounded down, is the gain of a
bucket. A document's weight is the sum of the gains of its features, read from the array, and its score the weight plus
a Gumbel draw that its key alone decides: the highest scores are a sample without replacement in proportion to the
importance weights. Ranks come from a radix sort (see :mod:`labelproof.llm.radix`) over the composite key of falling
score and rising document key.

Every text is counted and scored whole, in blocks of words. What goes through the driver is one number per bucket and
the extent of the keys. The documents are scanned twice rather than stored as buckets, which take as much room as text.

Defined cases: words are made of a-z, digits and all characters beyond ASCII, after A-Z is lowered. Texts that are null
or hold no word have no features and weight 0. A document of fewer than ``least_words`` words is scored and never drawn.
Equal scores go to the smaller key; a null key goes last and draws as an empty one. Repeated rows draw alike and get
neighbouring ranks. An empty target gives every document the gains of an empty target; an empty table gives no rows.
Other columns are not read. Keys are whole numbers; the sum of the gains of one text must fit 63 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm import radix
from labelproof.llm.batches import limited
from labelproof.session import stored

BUCKETS = 10_000
LONGEST = 3
BLOCK = 1 << 20
# a-z, digits and the bytes of characters beyond ASCII stay, A-Z are lowered, all else parts words
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time."""
    start = 0
    while start < len(text):
        # a block ends before a byte that parts words
        end = min(start + BLOCK, len(text))
        while end < len(text) and KEPT[text[end]] != 32:
            end += 1
        yield text[start:end].translate(KEPT).split()
        start = end


def features(text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs that begin at them), block by block."""

    def runs(words: list[bytes], starts: int) -> np.ndarray:
        spaced = [b" " + w for w in words]
        hashes = list(map(crc32, words[:starts]))
        found = hashes
        for size in range(1, longest):
            # the hash of a run goes on from that of the run without its last word
            hashes = list(map(crc32, spaced[size : starts + size], hashes))
            found = found + hashes
        return np.array(found, np.int64) % buckets

    waiting: list[bytes] = []
    for words in word_blocks(text):
        words = waiting + words
        starts = max(0, len(words) - longest + 1)
        waiting = words[starts:]
        yield starts, runs(words, starts)
    yield len(waiting), runs(waiting, len(waiting))


def counts(docs: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                if value:
                    for _, found in features(value, buckets, longest):
                        total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    parts = limited(docs.select(text)).mapInArrow(counted, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    # one row per bucket
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of smoothed shares, target over corpus, in whole thousandths rounded down."""
    all_corpus, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratios = ((t + 1.0) * all_corpus / ((s + 1.0) * all_target) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def gumbel(key: str, seed: int) -> Column:
    """A Gumbel draw in whole thousandths that the seed and the key alone decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def scored(
    docs: DataFrame, key: str, text: str, gain: np.ndarray, least_words: int = 20, seed: int = 42, longest: int = LONGEST
) -> DataFrame:
    """(key, n_words, n_features, weight, score) per row, with a chunk and place for those of enough words."""
    schema = T.StructType(
        [
            docs.schema[key],
            *(T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")),
            *radix.PLACES,
        ]
    )

    def weighed(batches):
        part, placed = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = []
            for value in batch.column(1).cast(pa.binary()).to_pylist():
                words = size = weight = 0
                for more, found in features(value or b"", len(gain), longest):
                    words, size, weight = words + more, size + len(found), weight + int(gain[found].sum())
                enough = words >= least_words
                where = divmod(placed, radix.CHUNK_ROWS) if enough else (None, None)
                placed += enough
                sums.append((words, size, weight, None if where[0] is None else (part << 32) + where[0], where[1]))
            columns = zip(*sums) if sums else ((),) * 5
            arrays = [pa.array(c, f) for c, f in zip(columns, (*[pa.int64()] * 4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [f.name for f in schema])

    weights = limited(docs.select(key, text)).mapInArrow(weighed, schema)
    return weights.withColumn("score", F.col("weight") + gumbel(key, seed))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """The rows that have a place, with their rank: falling ``score``, then rising ``key``."""
    rows = rows.filter(F.col(radix.CHUNK).isNotNull())
    extent = rows.agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.min(key).alias("first"), F.max(key).alias("last")
    ).first()
    if extent.low is None:
        return radix.ranked(rows, [], "rank")
    keys = [radix.Key(F.lit(extent.high) - F.col("score"), extent.high - extent.low)]
    if extent.first is not None:
        span = extent.last - extent.first
        if span + 1 < 1 << 63:
            from_first = F.coalesce(F.col(key).cast("long") - F.lit(extent.first), F.lit(span + 1))
            keys.append(radix.Key(from_first, span + 1))
        else:
            # keys from end to end of 64 bits: the sign bit turned over, and nulls after all others
            turned = F.coalesce(F.col(key).cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
            keys += [radix.Key(F.col(key).isNull().cast("long"), 1), radix.Key(turned, (1 << 64) - 1)]
    return radix.ranked(rows, keys, "rank")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    key: str,
    text: str,
    target_text: str,
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
) -> DataFrame:
    """(key, n_features, weight, score, rank) per row; the rank of those not drawn is null."""
    gain = gains(counts(docs, text), counts(target, target_text))
    # places must stay as they are from pass to pass
    rows = stored(scored(docs, key, text, gain, least_words, seed), "scored")
    order = ranked(rows, key)
    drawn = percent * rows.filter(F.col(radix.CHUNK).isNotNull()).count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    names = [key, "n_features", "weight", "score"]
    short = rows.filter(F.col(radix.CHUNK).isNull()).select(*names, F.lit(None).cast("long").alias("rank"))
    return order.select(*names, rank.alias("rank")).unionAll(short)
