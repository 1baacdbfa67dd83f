"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised items become one automaton; the words of each text stream through it while the longest match ending at
each word is tracked. A match of ``window`` words, or of the whole of a shorter item, marks its words as hit. A text
is contaminated where its hit words reach ``coverage`` of all its words.

The automaton is the only thing sent to the executors. It holds at most ``block_words`` item words (the bound of what
is broadcast); a larger item table is worked off in blocks of that size, each against all texts.

Defined cases: null and empty texts have no words, no hits and are clean. Items without words never occur. Items with
equal texts are all reported. An empty item table leaves every text clean. Repeated rows are judged one by one. Other
columns are never read by ``report`` and pass through ``clean_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.batches import bounded, tidy
from labelproof.session import stored

# Normalisation: A-Z in lower case; words are runs of digits, letters and everything beyond ASCII.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over word numbers.

    A state stands for a set of word sequences that end at the same places of the items; ``length`` is its longest
    and ``link`` leads to the state of the longest suffix that ends at more places.
    """

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        numbered = [[self.words.setdefault(w, len(self.words)) for w in item] for item in items]
        for item in numbered:
            last = 0
            for c in item:
                last = self._extended(last, c)
        self._mark(numbered)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of q that p reaches by c, as a state of its own."""
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extended(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # an earlier item already continued this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _mark(self, numbered: list[list[int]]) -> None:
        count = len(self.link)
        items: list[list[int]] = [[] for _ in range(count)]
        seen = [-1] * count
        whole: dict[int, list[tuple[int, int]]] = {}
        for number, item in enumerate(numbered):
            state = 0
            for c in item:
                state = self.step[state][c]
                up = state
                while up > 0 and seen[up] != number:
                    seen[up] = number
                    items[up].append(number)
                    up = self.link[up]
            if 0 < len(item) < self.window:
                whole.setdefault(state, []).append((len(item), number))
        # by falling length a state's link is settled after it, by rising length before it
        rising = sorted(range(1, count), key=self.length.__getitem__)
        # of each state: the state of its suffix of exactly window words
        self.windowed = [0] * count
        # of each state: the nearest state on its chain of links, itself included, that ends a short item
        self.short_end = [0] * count
        for s in rising:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.windowed[s] = s if self.length[up] < self.window else self.windowed[up]
            self.short_end[s] = s if s in whole else self.short_end[up]
        self.items = {s: items[s] for s in set(self.windowed) if s}
        self.whole = whole
        lengths = [min(len(i), self.window) for i in numbered if i]
        self.shortest = min(lengths, default=0)

    def scan(self, sequence: list[int], at: int, spans: list, found: set[int]) -> None:
        """Streams word numbers that begin at word ``at``; adds hit spans and items."""
        step, link, length = self.step, self.link, self.length
        state = matched = 0
        for i, c in enumerate(sequence, at + 1):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            follow = step[state].get(c)
            if follow is None:
                continue
            state = follow
            matched += 1
            if matched >= self.window:
                spans.append((i - self.window, i))
                found.update(self.items[self.windowed[state]])
            end = self.short_end[state]
            while end:
                for size, number in self.whole[end]:
                    if size <= matched:
                        spans.append((i - size, i))
                        found.add(number)
                end = self.short_end[link[end]]

    def hits(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(number of words, hit spans, items) of one text; spans are disjoint word ranges, end exclusive."""
        words = words_of(text)
        if not self.shortest or len(words) < self.shortest:
            return len(words), [], set()
        numbers = np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, len(words))
        # only runs of item words as long as the shortest window can hold one
        breaks = np.concatenate(([-1], np.flatnonzero(numbers < 0), [len(words)]))
        long_enough = np.flatnonzero(np.diff(breaks) > self.shortest)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for k in long_enough.tolist():
            start, end = int(breaks[k]) + 1, int(breaks[k + 1])
            self.scan(numbers[start:end].tolist(), start, spans, found)
        return len(words), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(items: DataFrame, item_key: str, item_text: str, block_words: int):
    """Lists of (item key, words), each of about ``block_words`` words at most."""
    rows = items.select(
        F.col(item_key).alias("key"),
        F.col(item_text).alias("text"),
        # a word and its gap take two bytes at least
        (F.octet_length(F.coalesce(F.col(item_text), F.lit(""))) / 2 + 1).alias("size"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil(total / block_words))
    for part in range(parts):
        block = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == part) if parts > 1 else rows
        yield part, parts, [(r.key, words_of(r.text.encode() if r.text else None)) for r in block.collect()]


def _as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def report(
    docs: DataFrame,
    items: DataFrame,
    key: str,
    text: str,
    item_key: str,
    item_text: str,
    window: int = 13,
    block_words: int = 400_000,
) -> DataFrame:
    """(key, n_words, n_hit, spans, items) per row: hit word ranges and the keys of the items found there."""
    kind = items.schema[item_key].dataType
    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    out = T.StructType(
        [
            docs.schema[key],
            T.StructField("__text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("items", T.ArrayType(kind)),
        ]
    )
    rows = rows.select(
        "*", F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"),
        F.array().cast(T.ArrayType(kind)).alias("items"),
    )
    for part, parts, block in _blocks(items, item_key, item_text, block_words):
        automaton = ItemAutomaton([words for _, words in block], window)
        keys = [k for k, _ in block]

        def judged(batches, automaton=automaton, keys=keys, last=part == parts - 1, first=part == 0):
            for batch in batches:
                counts, spans, found = [], [], []
                old = repeat(None) if first else zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                for value, before in zip(_as_bytes(batch.column("__text")), old):
                    n, ranges, numbers = automaton.hits(value)
                    named = [keys[i] for i in numbers]
                    if before:
                        ranges = merged(ranges + [(s["start"], s["end"]) for s in before[0]])
                        named += before[1]
                    counts.append(n)
                    spans.append([{"start": a, "end": b} for a, b in ranges])
                    found.append(named)
                kept = batch.column("__text")
                # the text is not needed after the last block
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.nulls(len(kept), pa.string()) if last else kept,
                        pa.array(counts, pa.int64()),
                        pa.array(spans, ARROW_SPANS),
                        pa.array(found, batch.schema.field("items").type),
                    ],
                    batch.schema.names,
                )

        rows = bounded(rows).mapInArrow(tidy(judged), out)
        if parts > 1:
            rows = stored(rows, "decontam")  # so that a task holds one automaton at a time
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(key, "n_words", hit.alias("n_hit"), "spans", "items")


def is_contaminated(n_words, n_hit, coverage_parts: int = 20):
    """Contaminated: any hit, and hit words are at least one in ``coverage_parts`` of all words."""
    return (n_hit > 0) & (n_hit * coverage_parts >= n_words)


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    text: str,
    item_key: str,
    item_text: str,
    window: int = 13,
    coverage_parts: int = 20,
    block_words: int = 400_000,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    if docs.schema[text].dataType != T.StringType():
        raise ValueError(f"{text} must be a string column")
    place = docs.columns.index(text)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    _, parts, block = next(_blocks(items, item_key, item_text, block_words))
    if parts > 1:
        # coverage adds up over blocks, so it is judged on the merged report, carried beside the row
        whole = rows.withColumn("row", F.struct(*rows.columns))
        judged = report(whole, items, "row", f"c{place}", item_key, item_text, window, block_words)
        kept = judged.filter(~is_contaminated(F.col("n_words"), F.col("n_hit"), coverage_parts))
        return kept.select("row.*").toDF(*names)
    automaton = ItemAutomaton([words for _, words in block], window)

    def kept(batches):
        for batch in batches:
            keep = []
            for value in _as_bytes(batch.column(place)):
                n, spans, _ = automaton.hits(value)
                hit = sum(b - a for a, b in spans)
                keep.append(not (hit > 0 and hit * coverage_parts >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bounded(rows).mapInArrow(tidy(kept), rows.schema).toDF(*names)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    data = text.encode()
    flags = np.frombuffer(data.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : edges[2 * start]])
        at = int(edges[2 * end - 1])
    return b"".join([*out, data[at:]]).decode()
