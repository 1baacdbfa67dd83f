"""Importance weights against plain Python, and ranks against a sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelproof.llm import importance, radix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_force(docs, items, least_words=20):
    bucket = [0] * 10000, [0] * 10000
    for side, texts in zip(bucket, ([t for _, t in docs], items)):
        for text in texts:
            for run in runs(text)[1]:
                side[zlib.crc32(run.encode()) % 10000] += 1
    s_all, t_all = sum(bucket[0]), sum(bucket[1])
    gain = [
        math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(*bucket)
    ]
    rows = []
    for key, text in docs:
        words, found = runs(text)
        weight = sum(gain[zlib.crc32(r.encode()) % 10000] for r in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(found), weight, score, None, len(words) >= least_words])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(order[: 5 * len(order) // 100], 1):
        row[4] = place
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def corpus():
    rng = random.Random(5)
    names = ["Alpha", "beta", "gämma", "delta9", "eps", "zeta", "eta", "theta"]
    docs = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(0, 60)))) for i in range(-100, 300)]
    # one row many times, as one source may repeat it
    docs += [(5000, "alpha beta, gämma " * 9)] * 150
    docs += [(6001, None), (6002, ""), (6003, " -- !"), (None, "alpha " * 30), (6004, "delta9 eps " * 60000)]
    return docs, ["alpha beta gämma delta9 " * 5, "eps eps zeta", None, ""]


def test_resampled_equals_brute_force(spark, monkeypatch):
    # runs and chunks that end inside texts and tasks
    monkeypatch.setattr(importance, "BLOCK", 64)
    monkeypatch.setattr(radix, "CHUNK_ROWS", 16)
    docs, items = corpus()
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, score long").repartition(5)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    found = importance.resampled(frame, target, "doc_id", "text", "text")
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_force(docs, items)


def test_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "d " * 30)], "doc_id long, text string")
    assert importance.resampled(docs, docs, "doc_id", "text", "text").count() == 0
    assert importance.resampled(docs, some, "doc_id", "text", "text").count() == 0
    found = importance.resampled(some, docs, "doc_id", "text", "text").collect()
    assert len(found) == 2 and {r["rank"] for r in found} == {None}


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "a b c d e", "x" * 50 + " y"])
def test_features_in_blocks(monkeypatch, text):
    whole = [sum(n for n, _ in importance.features(text.encode()))], sorted(
        np.concatenate([f for _, f in importance.features(text.encode())]).tolist()
    )
    monkeypatch.setattr(importance, "BLOCK", 2)
    parts = list(importance.features(text.encode()))
    assert [sum(n for n, _ in parts)] == whole[0] and sorted(np.concatenate([f for _, f in parts]).tolist()) == whole[1]
    assert whole[1] == sorted(zlib.crc32(r.encode()) % 10000 for r in runs(text)[1])


def numbered(spark, values, chunk_rows):
    rows = [(v, i, (i % 3 << 32) + i // 3 // chunk_rows, i // 3 % chunk_rows) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"v long, i long, {radix.CHUNK} long, {radix.PLACE} int").repartition(4)


@pytest.mark.parametrize("largest", [0, 1, 5000, (1 << 40) + 3, (1 << 64) - 1])
def test_ranks_follow_the_keys(spark, monkeypatch, largest):
    monkeypatch.setattr(radix, "CHUNK_ROWS", 32)
    rng = random.Random(largest)
    values = [rng.choice([0, largest, rng.randint(0, largest)]) for _ in range(400)]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    found = radix.ranked(numbered(spark, signed, 32), [radix.Key(F.col("v"), largest)], "rank").collect()
    by_rank = sorted(found, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 401))
    assert [values[r.i] for r in by_rank] == sorted(values)


def test_keys_from_end_to_end(spark):
    far = [(-(1 << 63), "a"), ((1 << 63) - 1, "a"), (0, "a"), (None, "a")]
    rows = spark.createDataFrame([(k, 7, 1 << 32, i) for i, (k, _) in enumerate(far)], f"k long, score long, {radix.CHUNK} long, {radix.PLACE} int")
    found = {r.k: r["rank"] for r in importance.ranked(rows, "k").collect()}
    assert found == {-(1 << 63): 1, 0: 2, (1 << 63) - 1: 3, None: 4}
