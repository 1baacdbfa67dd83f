"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, by DivideSkip.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of ``PERCENT`` or more; the
result is each document's set size and the smallest id it is linked with over any number of links.

1. Documents with equal sets are one class (``set_sizes``).
2. A class can have a partner only if at least 75 % of its shingles occur in another class. ``survivors`` finds the
   shingles of two classes or more: scan tasks send sorted arrays of hashed shingles to buckets of the hash space, a
   bucket answers with those that it got twice and how often. A shingle that is frequent within one scan task is sent
   once, with its count. Nearly all classes end here.
3. Shingles are ordered by frequency. Classes that link share one of each other's rarest 25 % (+1) shingles, so their
   inverted lists hold all candidates. In rounds, the classes of a list are compared with one of them, its hub; what
   links is one component and needs no more comparing. Two rounds of hubs are followed by one for the pairs of a list
   that are not yet connected. A pair is left out only where it is connected already, was compared before, or where
   its sizes rule a link out. So a group of near copies takes a star of comparisons and not all its pairs; what the
   last round still pairs are classes that consist of shingles of other classes and yet are not similar to them.
4. A comparison is a T-occurrence search (``divide_skip``): the hub's shingles are the query, the candidates' shingles
   make the lists, short lists are merged by a heap that skips ids which cannot reach the count, long lists are probed
   by binary search. Candidates of one hub are dealt into blocks of bounded size.

Defined cases: null and empty texts have no shingles and link with nothing, not even each other. A text of fewer than
five words is one shingle. Repeated rows link with each other. Ids must be neither null nor, for a meaningful
component, repeated; rows of null id are kept with a null component where nothing smaller links to them. Extra columns
are not read. An empty table gives no rows. Shingles are told apart by 64 hashed bits, sets by 128.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelproof.llm.batches import bounded, give_back, tidy
from labelproof.llm.columns import by_place
from labelproof.llm.components import components
from labelproof.llm.packing import from_planes, packed, planes, range_edges, unpacked
from labelproof.session import shuffle_width, stored

WORDS = 5
PERCENT = 75
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CACHED_WORDS = 200_000
CHUNK = 1_000_000  # shingles that a scan task gathers before it sends them
BUCKET = 1_200_000  # shingles of a bucket, about
FREQUENT = 64  # within a chunk
BLOCK = 256  # candidates of a block
ENTRIES, PAIRS, DIRECTORY, COUNTS = range(4)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted arrays of the distinct hashed shingles of texts."""

    def __init__(self):
        self.hashes = _WordHashes()

    def shingles(self, text: bytes | None) -> np.ndarray:
        # bytes are split at the six blanks of the definition
        words = text.translate(LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        ids = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        out = np.full(len(ids) - size + 1, size, np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def set_sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, digest) per row; the digest is null without shingles."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sizes, digests = [], []
            for value in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingler.shingles(value)
                sizes.append(len(found))
                digests.append(set_digest(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                ["key", "n_shingles", "digest"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return bounded(docs.select(key, text)).mapInArrow(tidy(run), f"key {kind}, n_shingles bigint, digest binary")


PARCEL = "bucket int, chunk bigint, kind int, a binary, b binary, c binary"
ARROW_PARCEL = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32())] + [(n, pa.binary()) for n in "abc"]
)


def _parcels(buckets: int, chunk: int, sets: dict[bytes, np.ndarray]):
    """Rows for the buckets from one chunk of classes."""
    sizes = np.array([len(s) for s in sets.values()], np.uint32)
    own = int(chunk % buckets)
    yield own, chunk, DIRECTORY, b"".join(sets), planes(sizes), None
    hashes = np.concatenate(list(sets.values()))
    classes = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, classes = hashes[order], classes[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    counts = np.diff(np.append(starts, len(hashes)))
    frequent = np.repeat(counts >= FREQUENT, counts)
    if frequent.any():
        yield own, chunk, PAIRS, packed(hashes[frequent]), planes(classes[frequent]), None
    # the hash space is cut into ranges, so the buckets are slices of the sorted hashes
    edges = range_edges(buckets)
    for kind, values, extra in (
        (ENTRIES, hashes[~frequent], classes[~frequent]),
        (COUNTS, hashes[starts[counts >= FREQUENT]], counts[counts >= FREQUENT].astype(np.uint32)),
    ):
        cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield bucket, chunk, kind, packed(values[a:b]), planes(extra[a:b]), None


def _parcel_batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_PARCEL)], schema=ARROW_PARCEL)


def _sent(batches, buckets: int):
    shingler, sets, total = Shingler(), {}, 0
    task = TaskContext.get().partitionId()
    number = 0
    for batch in batches:
        for value in batch.column(0).cast(pa.binary()).to_pylist():
            found = shingler.shingles(value)
            if len(found):
                sets[set_digest(found)] = found
                total += len(found)
            if total >= CHUNK:
                yield _parcel_batch(list(_parcels(buckets, (task << 24) + number, sets)))
                sets, total, number = {}, 0, number + 1
    if sets:
        yield _parcel_batch(list(_parcels(buckets, (task << 24) + number, sets)))


def _answered(table: pa.Table) -> pa.Table:
    """A bucket's answer: of each chunk's entries those that occur twice or more, with their number."""
    rows = table.to_pylist()
    out = [(0, r["chunk"], r["kind"], r["a"], r["b"], None) for r in rows if r["kind"] in (PAIRS, DIRECTORY)]
    sent = [r for r in rows if r["kind"] in (ENTRIES, COUNTS)]
    if sent:
        parts = [(unpacked(r["a"]), from_planes(r["b"], np.uint32)) for r in sent]
        hashes = np.concatenate([h for h, _ in parts])
        weights = np.concatenate(
            [e if r["kind"] == COUNTS else np.ones(len(e), np.uint32) for r, (_, e) in zip(sent, parts)]
        )
        values, where = np.unique(hashes, return_inverse=True)
        totals = np.bincount(where, weights).astype(np.uint32)[where]
        at = 0
        for r, (h, extra) in zip(sent, parts):
            often = totals[at : at + len(h)]
            at += len(h)
            keep = often > 1
            if keep.any():
                out.append((0, r["chunk"], r["kind"], packed(h[keep]), planes(extra[keep]), planes(often[keep])))
    return pa.Table.from_batches([_parcel_batch(out)], ARROW_PARCEL)


SURVIVOR = "digest binary, n bigint, shingles array<bigint>, prefix int"
ARROW_SURVIVOR = pa.schema(
    [("digest", pa.binary()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64())), ("prefix", pa.int32())]
)


def least_overlap(n: int) -> int:
    """A partner shares at least so many of n shingles."""
    return -(-PERCENT * n // 100)


def _gathered(table: pa.Table) -> pa.Table:
    """A chunk's classes that can have a partner, their shared shingles from the rarest on."""
    rows = table.to_pylist()
    directory = next(r for r in rows if r["kind"] == DIRECTORY)
    sizes = from_planes(directory["b"], np.uint32)
    hashes, classes, often = [], [], []
    for r in rows:
        if r["kind"] == ENTRIES:
            hashes.append(unpacked(r["a"]))
            classes.append(from_planes(r["b"], np.uint32))
            often.append(from_planes(r["c"], np.uint32))
    counted = [r for r in rows if r["kind"] == COUNTS]
    for r in rows:
        if r["kind"] == PAIRS:
            known = np.concatenate([unpacked(c["a"]) for c in counted])
            numbers = np.concatenate([from_planes(c["c"], np.uint32) for c in counted])
            order = np.argsort(known)
            own = unpacked(r["a"])
            hashes.append(own)
            classes.append(from_planes(r["b"], np.uint32))
            often.append(numbers[order][np.searchsorted(known[order], own)])
    out = []
    if hashes:
        h, c, o = np.concatenate(hashes), np.concatenate(classes), np.concatenate(often)
        order = np.lexsort((h, o, c))
        h, c = h[order], c[order]
        starts = np.searchsorted(c, np.arange(len(sizes) + 1))
        shared = np.diff(starts)
        for i in np.flatnonzero(shared * 100 >= PERCENT * sizes.astype(np.int64)).tolist():
            n, k = int(sizes[i]), int(shared[i])
            prefix = n - least_overlap(n) + 1 - (n - k)  # the unshared ones come first in the order
            if k:
                out.append(
                    (directory["a"][16 * i : 16 * i + 16], n, h[starts[i] : starts[i + 1]].view(np.int64), prefix)
                )
    columns = list(zip(*out)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_SURVIVOR)], schema=ARROW_SURVIVOR)


def _tidied(answer):
    """For groups of about a million numbers: the arrays of one are given back before the next."""

    def work(table: pa.Table) -> pa.Table:
        out = answer(table)
        give_back()
        return out

    return work


def survivors(docs: DataFrame, text: str, total: int) -> DataFrame:
    """Classes with enough shingles in common with others: digest, n, shared shingles (rarest first), prefix length."""
    buckets = max(shuffle_width(docs.sparkSession), math.ceil(total / BUCKET))
    sent = bounded(docs.select(text)).mapInArrow(tidy(lambda batches: _sent(batches, buckets)), PARCEL)
    answered = sent.groupBy("bucket").applyInArrow(_tidied(_answered), PARCEL)
    found = answered.groupBy("chunk").applyInArrow(_tidied(_gathered), SURVIVOR)
    # copies in different chunks are one class; their shingles are equal, and so is their order
    return stored(found.dropDuplicates(["digest"]), "survivors")


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids that occur in at least ``least`` of the sorted lists, and in how many.

    The longest lists are set aside: an id in ``least`` lists is in ``least`` minus their number of the others.
    """
    lists = sorted((l for l in lists if l), key=len, reverse=True)
    if least < 1 or len(lists) < least:
        return {}
    aside = min(least - 1, int(least / (0.01 * math.log2(len(lists[0]) + 1) + 1)))
    long, short, need = lists[:aside], lists[aside:], least - aside
    found = {}
    heap = [(l[0], k, 0) for k, l in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        same = []
        while heap and heap[0][0] == top:
            same.append(heapq.heappop(heap))
        if len(same) >= need:
            count = len(same)
            for k, l in enumerate(long):
                if count + len(long) - k < least:
                    break
                at = bisect_left(l, top)
                count += at < len(l) and l[at] == top
            if count >= least:
                found[top] = count
            for _, k, at in same:
                if at + 1 < len(short[k]):
                    heapq.heappush(heap, (short[k][at + 1], k, at + 1))
            continue
        # ids below the need-th smallest head are in too few lists; their lists skip to it
        while heap and len(same) < need - 1:
            same.append(heapq.heappop(heap))
        if not heap:
            break
        target = heap[0][0]
        for _, k, at in same:
            at = bisect_left(short[k], target, at)
            if at < len(short[k]):
                heapq.heappush(heap, (short[k][at], k, at))
    return found


def _searched(table: pa.Table) -> pa.Table:
    """One block: the hub as query against the lists of the candidates."""
    rows = table.to_pylist()
    hub = next(r for r in rows if r["is_hub"])
    candidates = [r for r in rows if not r["is_hub"]]
    query = np.sort(np.array(hub["shingles"], np.int64))
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for number, r in enumerate(candidates):
        own = np.array(r["shingles"], np.int64)
        at = np.minimum(np.searchsorted(query, own), len(query) - 1)
        for place in at[query[at] == own].tolist():
            lists[place].append(number)
    counts = divide_skip(lists, least_overlap(hub["n"]))
    out = []
    for number, common in counts.items():
        r = candidates[number]
        if 100 * common >= PERCENT * (hub["n"] + r["n"] - common):
            out.append((hub["hub"], r["other"]))
    columns = list(zip(*out)) or [()] * 2
    return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the pairs (hub, other) that link."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    dealt = pairs.join(sizes, "hub").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")))
    own = classes.select("digest", "n", "shingles")
    candidates = dealt.join(own, F.col("other") == F.col("digest")).select(
        "hub", "block", "other", "n", "shingles", F.lit(False).alias("is_hub")
    )
    hubs = (
        dealt.select("hub", "block")
        .distinct()
        .join(own, F.col("hub") == F.col("digest"))
        .select("hub", "block", F.col("hub").alias("other"), "n", "shingles", F.lit(True).alias("is_hub"))
    )
    return candidates.unionByName(hubs).groupBy("hub", "block").applyInArrow(_searched, "a binary, b binary")


def _may_link(n, rest, m, other_rest):
    """Whether two classes can link whose rarest common shingle leaves them so many from it on."""
    return F.least(rest, other_rest) * (100 + PERCENT) >= (n + m) * PERCENT


def class_links(classes: DataFrame, hub_rounds: int = 4) -> DataFrame:
    """(node, label) of the classes that link: label is the same exactly for connected classes."""
    spark = classes.sparkSession
    # rest: shingles from this one on in the order, which bounds the overlap where it is the rarest common one
    entries = stored(
        classes.select(
            "digest",
            "n",
            F.size("shingles").alias("shared"),
            F.posexplode(F.slice("shingles", F.lit(1), F.col("prefix"))).alias("pos", "shingle"),
        ).withColumn("rest", F.col("shared") - F.col("pos")),
        "lists",
    )
    links = spark.createDataFrame([], "a binary, b binary")
    tried = spark.createDataFrame([], "hub binary, other binary")
    labels = None
    for round_ in range(hub_rounds + 1):
        here = entries.withColumn("label", F.col("digest"))
        if labels is not None:
            here = entries.join(labels, F.col("digest") == F.col("node"), "left").withColumn(
                "label", F.coalesce("label", "digest")
            )
        # first the class with the largest part of shared shingles, the likely original; then others by chance
        rank = -F.col("shared") / F.col("n") if round_ == 0 else F.xxhash64("digest", F.lit(round_)).cast("double")
        first = F.min(F.struct(rank.alias("rank"), "digest", "n", "rest", "label"))
        # lists whose classes are all connected are done
        open_lists = (
            here.groupBy("shingle")
            .agg(F.min("label").alias("least"), F.max("label").alias("most"), first.alias("hub"))
            .filter("least <> most")
            .select("shingle", "hub")
        )
        here = stored(
            here.join(open_lists, "shingle").select("shingle", "digest", "n", "rest", "label", "hub"), "open-lists"
        )
        if here.isEmpty():
            break
        if round_ < hub_rounds:
            apart = (F.col("label") != F.col("hub.label")) & _may_link(
                F.col("n"), F.col("rest"), F.col("hub.n"), F.col("hub.rest")
            )
            pairs = here.filter(apart).select(F.col("hub.digest").alias("hub"), F.col("digest").alias("other"))
        else:
            names = ["digest", "n", "rest", "label"]
            left = here.select("shingle", *(F.col(c).alias(f"hub_{c}") for c in names))
            pairs = (
                left.join(here.select("shingle", *names), "shingle")
                .filter((F.col("hub_digest") < F.col("digest")) & (F.col("hub_label") != F.col("label")))
                .filter(_may_link(F.col("n"), F.col("rest"), F.col("hub_n"), F.col("hub_rest")))
                .select(F.col("hub_digest").alias("hub"), F.col("digest").alias("other"))
            )
        pairs = stored(pairs.distinct().join(tried, ["hub", "other"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        found = stored(_links(pairs, classes), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    if labels is None:
        return spark.createDataFrame([], "node binary, label binary")
    return labels


def linked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, component_id) per row."""
    sizes = stored(set_sizes(docs, key, text), "shingle-sets")
    firsts = sizes.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"), F.max("n_shingles").alias("n"))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    labels = class_links(survivors(docs, text, total))
    named = firsts.join(labels, F.col("digest") == F.col("node"), "left").select(
        "digest", "first", F.coalesce("label", "digest").alias("label")
    )
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    roots = named.join(least, "label").select("digest", "component")
    return sizes.join(roots, "digest", "left").select(
        F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component_id")
    )


def representatives(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all columns.

    Of rows that repeat a key the one with the smallest text stays; rows with a null key all stay where no other text
    is like theirs.
    """
    rows, place = by_place(docs)
    id_, names = place[key], docs.columns
    own = F.col("component_id").eqNullSafe(F.col(id_))
    firsts = linked(rows, id_, place[text]).filter(own).groupBy(F.col(id_).alias("first"))
    firsts = stored(firsts.agg(F.count("*").alias("copies")), "firsts")
    same = F.col(id_).eqNullSafe(F.col("first"))
    several = firsts.filter("copies > 1 AND first IS NOT NULL")
    if several.isEmpty():
        return rows.join(firsts, same, "left_semi").toDF(*names)
    single = rows.join(firsts.filter("copies = 1 OR first IS NULL"), same, "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_).orderBy(place[text])).alias("nth")
    one = rows.join(several, same, "left_semi").select("*", nth).filter("nth = 1").drop("nth")
    return single.unionByName(one).toDF(*names)
