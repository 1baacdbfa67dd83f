"""Exact copies and near-duplicates without comparing all pairs.

Texts become word-count profiles over a fixed number of buckets; a profile has
a 256-bit difference hash. Two items are near-duplicates when their hashes
differ in few bits and their profiles are almost parallel.

* Copies collapse first: one link per copy to the lowest key of its content,
  then one link per content to the lowest key of its profile. Pairs are only
  formed between different profiles, so a content held by a third of all rows
  costs one link per row and no pairs.
* Candidates share a join key. If at most ``d`` of ``b`` hash bands differ, at
  least ``b - d`` are equal; putting the bands in ``b - d - 1`` groups, some
  group holds two equal bands, so the band pairs inside the groups are a complete
  family of keys.
* A crowded key (short texts have mostly constant hashes) becomes an inverted
  index over the profiles' features, rarest first. What a profile does not share
  with a near one is at most ``1 - similarity^2`` of its squared norm, so a
  feature is listed as the first shared one only while what comes before it is
  no more than that, and a pair of features as the first two while what comes
  before the second, without the first, is no more. Crowded features are listed
  by such pairs. A profile that one feature makes up nearly alone may share that
  one only; it is compared with those that hold much of one feature.
* What is still crowded (mostly pairs that are links) is cut into cells in which
  each pair of rows meets once, so that no task grows with it.

A pair is produced once, at the first key and first features it shares.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions.vectors import hamming
from labelproof.operators.skew import lookup_by_heavy_key
from labelproof.session import spread, stored

PROFILE_SIZE = 257
HASH_BITS = PROFILE_SIZE - 1


PROFILE = "array<struct<b:int,c:bigint>>"


def hash_bands(buckets: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """Difference hash of a sparse profile as 64-bit numbers: bit i is 0 where bucket i holds more than bucket i + 1."""
    dense = np.zeros(size, np.int64)
    dense[buckets] = counts
    return np.packbits(dense[1:] >= dense[:-1]).view(">i8").astype(np.int64)


def text_profiles(df: DataFrame, key: str, text: str, size: int = PROFILE_SIZE) -> DataFrame:
    """Per row with a text: content digest, word counts by bucket as sorted ``entries`` (at most ``size``), the digest
    of these as ``profile`` and their difference hash as ``bands``.

    A profile depends on its row alone, so it is counted inside the scan task, batch by batch: no shuffle. A word's
    bucket is the first 32 bits of its MD5 digest modulo ``size``.
    """
    rows = spread(df.filter(F.col(text).isNotNull()).select(key, text))
    lowered = rows.select(key, F.sha2(text, 256).alias("digest"), F.lower(text).cast("binary").alias("t"))

    def counted(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            numbers, counts, lengths, digests, bands = [], [], [], [], []
            for value in batch.column(2).to_pylist():
                # the six ASCII blanks part words, as the SQL pattern for blanks does
                places = []
                for word in value.split():
                    place = known.get(word)
                    if place is None:
                        if len(known) > 200_000:
                            known.clear()
                        place = known[word] = int.from_bytes(hashlib.md5(word).digest()[:4]) % size
                    places.append(place)
                per = np.bincount(np.array(places, np.int64), minlength=1)
                filled = np.flatnonzero(per)
                numbers.append(filled)
                counts.append(per[filled])
                lengths.append(len(filled))
                digests.append(hashlib.sha256(filled.tobytes() + per[filled].tobytes()).hexdigest())
                bands.append(hash_bands(filled, per[filled], size))
            entry = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(numbers), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], ["b", "c"]
            )
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            width = pa.array(np.arange(len(bands) + 1, dtype=np.int32) * ((size - 1) // 64))
            hashes = pa.ListArray.from_arrays(width, pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, entry), pa.array(digests), hashes],
                [key, "digest", "entries", "profile", "bands"],
            )

    kind = df.schema[key].dataType.simpleString()
    return lowered.mapInArrow(counted, f"`{key}` {kind}, digest string, entries {PROFILE}, profile string, bands array<bigint>")


def copy_links(items: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(links, groups): every row beyond the lowest key of its digest, and one row per digest."""
    groups = items.groupBy(digest).agg(F.min(key).alias("keep"), F.count(F.lit(1)).alias("copies"))
    return links_to_first(items.select(key, digest), groups, key, digest), groups


def links_to_first(items: DataFrame, groups: DataFrame, key: str, digest: str) -> DataFrame:
    """A link to the kept row of its digest for every other row."""
    links = lookup_by_heavy_key(items, groups.filter("copies > 1"), digest, "copies")
    return links.filter(F.col(key) != F.col("keep")).select(F.col("keep").alias("left_id"), F.col(key).alias("right_id"))


def narrow_bands(bands: Column, width: int) -> list[Column]:
    """The hash as bands of ``width`` bits (64 or 16)."""
    if width == 64:
        return [F.element_at(bands, i + 1) for i in range(HASH_BITS // 64)]
    mask = (1 << width) - 1
    return [
        F.shiftrightunsigned(F.element_at(bands, b + 1), 64 - width * (i + 1)).bitwiseAND(F.lit(mask))
        for b in range(HASH_BITS // 64)
        for i in range(64 // width)
    ]


def key_family(bands: int, max_distance: int) -> list[tuple[int, int]]:
    """Band pairs of which every pair of hashes within the distance has one equal."""
    groups = bands - max_distance - 1
    if groups < 1:
        raise ValueError("too few bands for this distance")
    members = [list(range(bands))[g::groups] for g in range(groups)]
    return [pair for m in members for pair in combinations(m, 2)]


def squared_norm(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e["c"] * e["c"])


def rarity(profiles: DataFrame, size: int = PROFILE_SIZE) -> list[int]:
    """The place of each bucket when buckets are ordered by the number of profiles that fill them, rarest first.

    Collects one number per bucket.
    """
    filled = profiles.select(F.explode("entries.b").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    uses = {r.b: r.n for r in filled}
    order = sorted(range(size), key=lambda b: (uses.get(b, 0), b))
    place = [0] * size
    for i, b in enumerate(order):
        place[b] = i
    return place


PROBES = "array<struct<f:int,seconds:array<int>>>"


def probes(features: np.ndarray, counts: np.ndarray, min_similarity: float):
    """(first features with their second ones, all features listed, dominated, near dominated) of one profile.

    ``features`` are numbered by rarity and ascend. ``dominated``: one feature holds all but what may be unshared;
    ``near dominated``: one holds as much as it must in a profile near a dominated one.
    """
    squares = counts.astype(np.float64) ** 2
    mass = squares / squares.sum() if len(squares) else squares
    before = np.cumsum(mass) - mass
    spare = 1.0 - min_similarity**2 + 1e-9
    firsts = int(np.searchsorted(before, spare, "right"))
    ends = np.searchsorted(before, spare + mass[:firsts], "right")
    found = [(int(features[i]), features[i + 1 : ends[i]].tolist()) for i in range(firsts)]
    most = mass.max(initial=0.0)
    least = max(0.0, min_similarity - (2.0 - 2.0 * min_similarity) ** 0.5) ** 2
    return found, features[: ends.max(initial=0)].tolist(), bool(1.0 - most <= spare), bool(most >= least - 1e-9)


def with_probes(profiles: DataFrame, key: str, min_similarity: float) -> DataFrame:
    """(key, bands, listed, probes, dominated, near_dominated) per profile; one number per bucket goes through the driver."""
    place = np.array(rarity(profiles), np.int32)

    def work(batches):
        for batch in batches:
            offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values
            numbers, counts = place[flat.field(0).to_numpy()], flat.field(1).to_numpy()
            rows = []
            for low, high in zip(offsets, offsets[1:]):
                order = np.argsort(numbers[low:high])
                rows.append(probes(numbers[low:high][order], counts[low:high][order], min_similarity))
            found = [[{"f": f, "seconds": g} for f, g in r[0]] for r in rows]
            kind = pa.list_(pa.struct([("f", pa.int32()), ("seconds", pa.list_(pa.int32()))]))
            arrays = [pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array(found, kind)]
            flags = [pa.array([r[i] for r in rows], pa.bool_()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays, *flags], [key, "bands", "listed", "probes", "dominated", "near_dominated"]
            )

    kind = profiles.schema[key].dataType.simpleString()
    return profiles.select(key, "bands", "entries").mapInArrow(
        work, f"`{key}` {kind}, bands array<bigint>, listed array<int>, probes {PROBES}, dominated boolean, near_dominated boolean"
    )


def with_cosine(pairs: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id, distance, le, re) with the cosine of both profiles instead of their entries."""

    def dense(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return column.offsets.to_numpy(), column.values.field(0).to_numpy(), column.values.field(1).to_numpy()

    def work(batches):
        for batch in batches:
            sides = [dense(batch.column(i)) for i in (3, 4)]
            found = []
            for row in range(batch.num_rows):
                (lb, lc), (rb, rc) = ((b[o[row] : o[row + 1]], c[o[row] : o[row + 1]]) for o, b, c in sides)
                _, at_left, at_right = np.intersect1d(lb, rb, assume_unique=True, return_indices=True)
                norms = float((lc * lc).sum()) * float((rc * rc).sum())
                found.append(float((lc[at_left] * rc[at_right]).sum()) / norms**0.5 if norms else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.float64())], ["left_id", "right_id", "distance", "similarity"]
            )

    fields = [pairs.schema[c] for c in ("left_id", "right_id", "distance")] + [T.StructField("similarity", T.DoubleType())]
    return pairs.select("left_id", "right_id", "distance", "le", "re").mapInArrow(work, T.StructType(fields))


CROWD = 2048
# rows under a first shared feature that are still compared with each other
FEW = 16
# in place of a feature: the key is not split further; the pair may share one feature only
ANY, ALONE = -2, -1


def crowded_keys(keyed: DataFrame, keys: list[str], limit: int) -> DataFrame:
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return counts.select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("blocks"))


def split_crowded(keyed: DataFrame, keys: list[str], row: str, limit: int = CROWD) -> DataFrame:
    """Cut crowded join keys into cells so that no task compares a whole crowd.

    A key with n rows gets ``ceil(n / limit)`` blocks by row hash. A row of block
    b goes to the cells (b, j) for every block j, so two rows meet in exactly one
    cell that is theirs: nothing is lost and a cell holds about two blocks.
    """
    rows = keyed.join(crowded_keys(keyed, keys, limit), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(row), F.col("blocks")).cast("int"))
    cells = rows.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.withColumn("lo", F.least("block", "__j")).withColumn("hi", F.greatest("block", "__j")).drop("__j", "blocks")


def hash_candidates(rows: DataFrame, key: str, *, max_distance: int, width: int, crowd: int = CROWD) -> DataFrame:
    """Pairs of rows whose 256-bit hashes differ in at most ``max_distance`` bits, each pair once.

    ``rows`` may hold the columns of :func:`with_probes`; then only pairs that share the features they must are given
    for keys of more than ``crowd`` rows. Without them such keys are cut into cells alone.
    """
    family = key_family(HASH_BITS // width, max_distance)
    if "probes" in rows.columns:
        hashed = rows.select(key, "bands", "listed", "probes", "dominated", "near_dominated")
    else:
        one = F.array(F.struct(F.lit(0).alias("f"), F.array().cast("array<int>").alias("seconds")))
        no = F.array(F.lit(0))
        hashed = rows.select(
            key, "bands", no.alias("listed"), one.alias("probes"), F.lit(True).alias("dominated"), F.lit(True).alias("near_dominated")
        )
    parts = narrow_bands(F.col("bands"), width)
    keys = F.array(
        *[F.struct(F.lit(i).alias("k"), parts[a].alias("x"), parts[b].alias("y")) for i, (a, b) in enumerate(family)]
    )
    band_keys, first, second = ["k", "x", "y"], ["k", "x", "y", "f"], ["k", "x", "y", "f", "g"]
    keyed = hashed.select("*", F.inline(keys))
    # mostly no key is crowded; the plan for those that are is then left out
    crowded = stored(crowded_keys(keyed, band_keys, crowd), "crowded")
    by_key = keyed.join(crowded, band_keys, "left")
    whole = {"block": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)}
    kept = [key, "bands", "listed", "dominated", *second, *whole]
    if crowded.isEmpty():
        by_key = keyed.withColumn("blocks", F.lit(None).cast("int"))
    light = by_key.filter("blocks IS NULL").withColumns({"f": F.lit(ANY), "g": F.lit(ANY), **whole})
    listed = by_key.filter("blocks IS NOT NULL").drop("blocks").select("*", F.inline("probes"))
    by_first = listed.join(crowded_keys(listed, first, min(FEW, crowd)), first, "left")
    few = by_first.filter("blocks IS NULL").withColumns({"g": F.lit(ANY), **whole})
    alone = F.array(F.lit(ALONE))
    seconds = F.when(F.col("dominated"), alone).when(F.col("near_dominated"), F.concat("seconds", alone)).otherwise(F.col("seconds"))
    many = by_first.filter("blocks IS NOT NULL").drop("blocks").withColumn("g", F.explode(seconds))
    celled = light.select(*kept)
    if not crowded.isEmpty():
        celled = celled.unionAll(few.select(*kept)).unionAll(split_crowded(many, second, key, crowd).select(*kept))
    on = [*second, "lo", "hi"]
    names = {"block": "block", key: "id", "bands": "b", "listed": "p", "dominated": "d"}
    left = celled.select(*on, *[F.col(c).alias(f"left_{n}") for c, n in names.items()])
    right = celled.select(*on, *[F.col(c).alias(f"right_{n}") for c, n in names.items()])
    once = (F.col("lo") == F.col("hi")) | (F.col("left_block") != F.col("right_block"))
    joined = left.join(right, on).filter((F.col("left_id") < F.col("right_id")) & once)
    lparts, rparts = narrow_bands(F.col("left_b"), width), narrow_bands(F.col("right_b"), width)
    equal = F.array(*[(lparts[a] == rparts[a]) & (lparts[b] == rparts[b]) for a, b in family])
    first_key = F.array_position(equal, True) == F.col("k") + 1
    shared = F.sort_array(F.array_intersect("left_p", "right_p"))
    first_feature = (F.col("f") == ANY) | (F.get(shared, 0) == F.col("f"))
    either = F.col("left_d") | F.col("right_d")
    second_feature = (F.col("g") == ANY) | F.when(F.col("g") == ALONE, either).otherwise(F.get(shared, 1) == F.col("g"))
    found = joined.withColumn("distance", hamming(F.col("left_b"), F.col("right_b")))
    found = found.filter((F.col("distance") <= max_distance) & first_key & first_feature & second_feature)
    return found.select("left_id", "right_id", "distance")


def near_pairs(
    profiles: DataFrame, key: str, *, max_distance: int, width: int, min_similarity: float, crowd: int = CROWD
) -> DataFrame:
    """Pairs of rows with different profiles within the hash distance and above the cosine.

    ``profiles`` has one row per distinct profile with ``bands`` and ``entries``.
    """
    # read by the counts of every level of keys and by both sides of the join
    hashed = stored(with_probes(profiles, key, min_similarity), "probes")
    found = hash_candidates(hashed, key, max_distance=max_distance, width=width, crowd=crowd)
    a = profiles.select(F.col(key).alias("left_id"), F.col("entries").alias("le"))
    b = profiles.select(F.col(key).alias("right_id"), F.col("entries").alias("re"))
    return with_cosine(found.join(a, "left_id").join(b, "right_id")).filter(F.col("similarity") >= min_similarity)


def suspicious_links(
    df: DataFrame,
    key: str,
    text: str,
    *,
    max_distance: int = 2,
    width: int = 64,
    min_similarity: float = 0.995,
    crowd: int = CROWD,
) -> DataFrame:
    """All links of a text table: exact copies, equal profiles and near pairs.

    ``kind`` tells them apart: ``copy`` and ``same_profile`` link a row to the
    lowest key of its content or profile; ``near`` links two profiles.
    """
    # read several times below: written once so texts are scanned and hashed once
    profiles = stored(text_profiles(df, key, text), "profiles")
    # one row per content; equal contents have equal profiles
    firsts = [F.min(key).alias("keep"), F.count(F.lit(1)).alias("copies"), F.first("profile").alias("profile")]
    contents = stored(profiles.select(key, "digest", "profile").groupBy("digest").agg(*firsts), "contents")
    copies = links_to_first(profiles.select(key, "digest"), contents.drop("profile"), key, "digest")
    one = contents.select(F.col("keep").alias(key), "profile")
    same, kept = copy_links(one, key, "profile")
    distinct_profiles = profiles.join(kept.select(F.col("keep").alias(key)), key, "left_semi")
    distinct_profiles = stored(distinct_profiles.select(key, "entries", "bands"), "distinct-profiles")
    near = near_pairs(
        distinct_profiles, key, max_distance=max_distance, width=width, min_similarity=min_similarity, crowd=crowd
    )

    def tagged(links: DataFrame, kind: str) -> DataFrame:
        return links.select(
            "left_id", "right_id", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("distance"), F.lit(1.0).alias("similarity")
        )

    return (
        tagged(copies, "copy")
        .unionByName(tagged(same, "same_profile"))
        .unionByName(near.select("left_id", "right_id", F.lit("near").alias("kind"), "distance", "similarity"))
    )
