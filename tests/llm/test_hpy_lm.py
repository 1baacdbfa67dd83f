"""The language model: exact base scores, seating as customer by customer, probabilities that add up, held-out gain."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from labelproof.llm import hpy_lm, queries


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def base_scores(rows):
    count = Counter(t for _, text, training in rows if training for t in tokens(text))
    n, v = sum(count.values()), len(count)
    return {
        key: (len(tokens(text)), sum(count[t] > 0 for t in tokens(text)),
              sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text)))
        for key, text, _ in rows
    }, n


def test_seating_follows_the_process():
    rng = np.random.default_rng(1)
    for customers, rate, discount in ((2, 0.5, 0.3), (20, 1.5, 0.5), (400, 0.7, 0.2)):
        got = hpy_lm.seated(np.full(20_000, customers), np.full(20_000, rate), discount, rng)
        want = []
        for _ in range(1500):
            tables = 1
            for others in range(1, customers):
                tables += rng.random() * (rate + others - discount * tables) < rate
            want.append(tables)
        spread = np.std(want) / math.sqrt(len(want)) + 0.02
        assert abs(got.mean() - np.mean(want)) < 4 * spread


def small_docs(spark):
    rows = [
        (1, "the cat sat on the mat the cat", True),
        (2, "The dog sat on\tthe log", True),
        (2, "The dog sat on\tthe log", True),
        (3, None, True),
        (4, "", False),
        (5, "the bird sat on an unknown thing", False),
        (None, "word " * 30_000, None),
    ]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score boolean")


def test_rows_and_base(spark, monkeypatch):
    rows, docs = small_docs(spark)
    want, n = base_scores([r for r in rows])
    results = []
    for chunk, bucket in ((2_500_000, 3_000_000), (10, 20)):
        monkeypatch.setattr(hpy_lm, "CHUNK", chunk)
        monkeypatch.setattr(hpy_lm, "BUCKET", bucket)
        model = hpy_lm.fit(docs, "doc_id", "text", F.col("score"))
        assert model.setting.tokens == n
        found = hpy_lm.scores(docs, "doc_id", "text", model).collect()
        assert len(found) == len(rows)
        for r in found:
            size, known, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known) == (size, known)
            assert abs(r.base_score - base) < 1e-5 * max(1, abs(base))
            assert r.score < 0
        results.append(found)


def test_probabilities_add_up(spark):
    _, docs = small_docs(spark)
    model = hpy_lm.fit(docs, "doc_id", "text", F.col("score"))
    buckets = {r["bucket"]: hpy_lm.Bucket(r.asDict()) for r in model.counts.collect()}
    hashes = hpy_lm._WordHashes()
    for before in ("the", "sat", "never"):
        context = hpy_lm.contexts_of(np.array([hashes[before.encode()], 0], np.uint64))[1]
        total = 0.0
        for bucket in buckets.values():
            scorer = hpy_lm.Scorer(bucket, model.setting, model.history, model.burn_in)
            logs, _, known = scorer.log_probabilities(bucket.words, np.full(len(bucket.words), context))
            assert known.all()
            total += (10**logs).sum()
        scorer = hpy_lm.Scorer(None, model.setting, model.history, model.burn_in)
        total += 10 ** scorer.log_probabilities(np.array([12345], np.uint64), np.array([context]))[0][0]
        assert abs(total - 1) < 1e-9


def test_without_training_rows(spark):
    _, docs = small_docs(spark)
    model = hpy_lm.fit(docs, "doc_id", "text", F.lit(False))
    found = hpy_lm.scores(docs, "doc_id", "text", model).collect()
    assert len(found) == 7 and all(r.n_known == 0 and np.isfinite(r.score) for r in found)
    empty = docs.limit(0)
    assert hpy_lm.scores(empty, "doc_id", "text", hpy_lm.fit(empty, "doc_id", "text", F.col("score"))).count() == 0


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in docs]
    want, n = base_scores(rows)
    found = queries.QUERIES["op9_lm_scoring"](spark, folder).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == n
        assert abs(r.base_score - want[r.doc_id][2]) < 1e-5
    held_out = [r for r in found if r.held_out]
    # the context helps on texts that were not learned from
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)
