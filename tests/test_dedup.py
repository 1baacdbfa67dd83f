"""Links and pairs against brute force, including crowded keys."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelproof.operators import dedup

WORDS = [f"w{i}" for i in range(400)]


def profile(text):
    counts = [0] * 257
    for w in re.split(r"\s+", text.lower()):
        if w:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 257] += 1
    return counts


def bits(counts):
    value = 0
    for a, b in zip(counts, counts[1:]):
        value = value << 1 | (b >= a)
    return value


def brute_force(texts, distance, similarity):
    links, contents, profiles = set(), {}, {}
    for i, t in texts:
        if t in contents:
            links.add((contents[t], i, "copy"))
        else:
            contents[t] = i
    for t, i in contents.items():
        p = tuple(profile(t))
        if p in profiles:
            links.add((profiles[p], i, "same_profile"))
        else:
            profiles[p] = i
    for (p, i), (q, j) in itertools.combinations(profiles.items(), 2):
        if (bits(p) ^ bits(q)).bit_count() <= distance and any(p) and any(q):
            cos = sum(a * b for a, b in zip(p, q)) / math.sqrt(sum(a * a for a in p) * sum(b * b for b in q))
            if cos >= similarity:
                links.add((min(i, j), max(i, j), "near"))
    return links


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["", "  ", "one", "two", "one one", "one one one"]
    base = [" ".join(rng.choices(WORDS, k=rng.choice([1, 2, 3, 40, 300]))) for _ in range(60)]
    for b in base:
        out.append(b)
        words = b.split()
        if len(words) >= 40:
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            out += [" ".join(words), " ".join(reversed(b.split()))]
    out += [base[0]] * 50  # one content with a third of the rows
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("distance, width", [(2, 64), (8, 16)])
@pytest.mark.parametrize("similarity", [0.995, 0.9])
@pytest.mark.parametrize("crowd", [3, 2048])
def test_links(spark, texts, distance, width, similarity, crowd):
    df = spark.createDataFrame(texts, "id bigint, text string").repartition(5)
    out = dedup.suspicious_links(df, "id", "text", max_distance=distance, width=width, min_similarity=similarity, crowd=crowd)
    rows = out.collect()
    found = {(r["left_id"], r["right_id"], r["kind"]) for r in rows}
    assert len(rows) == len(found)
    assert found == brute_force(texts, distance, similarity)
    assert any(k == "near" for *_, k in found)


def crowd_of(n, rng):
    """Texts of two to six words whose hashes are all alike in the test below."""
    return [(i, " ".join(rng.choices(WORDS, k=rng.randint(2, 6)))) for i in range(n)]


def test_a_crowd_under_one_key_is_not_compared_pair_by_pair(spark, monkeypatch):
    """All rows have one hash: candidates follow the rows and the links, not the pairs."""
    rng = random.Random(4)
    profiles = {tuple(profile(t)): i for i, t in crowd_of(20000, rng)}
    rows = [(i, [(b, c) for b, c in enumerate(p) if c]) for p, i in profiles.items()]
    frame = spark.createDataFrame(rows, "id long, entries array<struct<b:int,c:bigint>>").withColumn("bands", F.array(*[F.lit(0)] * 4).cast("array<bigint>"))
    frame = frame.repartition(8).cache()
    probed = dedup.with_probes(frame, "id", 0.995)
    found = dedup.hash_candidates(probed, "id", max_distance=2, width=64, crowd=200)
    links = dedup.near_pairs(frame, "id", max_distance=2, width=64, min_similarity=0.995, crowd=200).count()
    assert len(rows) > 15000 and found.count() < 4 * (len(rows) + links)


@pytest.mark.parametrize("similarity", [0.995, 0.9, 0.5])
def test_probes_lose_no_near_pair(similarity):
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        size = rng.choice([1, 2, 3, 8, 30])
        entries = {rng.randrange(40): rng.choice([1, 1, 2, 5, 60]) for _ in range(size)}
        rows.append(entries)
        near = dict(entries)
        near[rng.randrange(40)] = rng.choice([1, 2, 3])
        rows.append(near)

    def probed(entries):
        features = np.array(sorted(entries))
        return dedup.probes(features, np.array([entries[f] for f in features]), similarity)

    seen = 0
    for (x, px), (y, py) in itertools.combinations([(r, probed(r)) for r in rows], 2):
        dot = sum(c * y.get(b, 0) for b, c in x.items())
        if dot / math.sqrt(sum(c * c for c in x.values()) * sum(c * c for c in y.values())) < similarity:
            continue
        seen += 1
        shared = sorted(set(x) & set(y))
        firsts = [dict(p[0]) for p in (px, py)]
        assert all(shared[0] in f for f in firsts)
        if px[2] or py[2]:
            assert px[3] and py[3]
        else:
            assert all(shared[1] in f[shared[0]] for f in firsts) and all(set(shared[:2]) <= set(p[1]) for p in (px, py))
    assert seen > 100


def test_key_family_covers_every_pattern():
    for bands, distance in ((4, 2), (16, 8)):
        family = dedup.key_family(bands, distance)
        for changed in itertools.combinations(range(bands), distance):
            assert any(a not in changed and b not in changed for a, b in family)


def test_crowded_keys_meet_once(spark):
    keyed = spark.range(300).select(F.lit(1).alias("k"), F.col("id"))
    cells = dedup.split_crowded(keyed, ["k"], "id", limit=40)
    a = cells.select("lo", "hi", F.col("block").alias("x"), F.col("id").alias("i"))
    b = cells.select("lo", "hi", F.col("block").alias("y"), F.col("id").alias("j"))
    pairs = a.join(b, ["lo", "hi"]).filter("i < j AND (lo = hi OR x <> y)")
    assert pairs.count() == pairs.select("i", "j").distinct().count() == 300 * 299 // 2
    assert cells.groupBy("lo", "hi").count().agg(F.max("count")).first()[0] < 150


def test_plan_has_no_cross_join(spark, texts):
    df = spark.createDataFrame(texts, "id bigint, text string")
    plan = dedup.suspicious_links(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
