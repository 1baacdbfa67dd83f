"""Fingerprints: sums of paragraphs, likeness, edited texts against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelproof.llm import fingerprint, queries


def prints(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in fingerprint.fingerprints(docs, "doc_id", "text").collect()}


def test_order_of_paragraphs_does_not_matter(spark):
    found = prints(spark, ["one two\nthree\n", "three\n\none two", "one two\nthree", "three one two", None, ""])
    assert found[0].identity == found[1].identity and found[0].sketch == found[1].sketch
    assert len({tuple(found[i].identity) for i in (0, 2, 3, 4)}) == 4
    assert found[4].identity == found[5].identity


def test_insertion_and_deletion(spark):
    texts = ["a b c\nd e f g\na b c", "d e f g", "a b c\na b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = fingerprint.fingerprints(docs, "doc_id", "text")
    row = found.select(*(F.struct(F.lit(1).alias("x"), "*").alias("r"),)).groupBy().agg(
        *(F.max(F.when(F.col("r.doc_id") == i, F.col("r"))).alias(f"r{i}") for i in range(3))
    )
    more = fingerprint.inserted(F.col("r2.identity"), F.col("r2.sketch"), F.col("r1.identity"), F.col("r1.sketch"))
    less = fingerprint.deleted(F.col("r0.identity"), F.col("r0.sketch"), F.col("r1.identity"), F.col("r1.sketch"))
    got = row.select(
        *((more[i] == F.col(f"r0.{n}")).alias(f"more_{n}") for i, n in enumerate(("identity", "sketch"))),
        *((less[i] == F.col(f"r2.{n}")).alias(f"less_{n}") for i, n in enumerate(("identity", "sketch"))),
    ).first()
    assert all(got)


def pair_cosine(a, b):
    def pairs(text):
        out = Counter()
        for line in text.split("\n"):
            words = line.split(" ")
            out.update(zip(words, [*words[1:], None]))
        return out

    x, y = pairs(a), pairs(b)
    dot = sum(x[k] * y[k] for k in x)
    return dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def edited(text, following):
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def test_query_against_plain_python(spark, folder):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = {r.doc_id: r for r in queries.QUERIES["op10_fingerprints"](spark, folder).collect()}
    assert len(rows) == len(docs)
    by_print, off = {}, []
    for (key, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        r = rows[key]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited(text, after).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 8 * 8 + 6 * 124
        assert by_print.setdefault(text, r.fingerprint) == r.fingerprint
        if len(text) > 300:
            off.append(r.near_edited - pair_cosine(text, edited(text, after)))
    assert len(set(by_print.values())) == len(by_print)
    assert sum(abs(x) for x in off) / len(off) < 0.1


def test_rows(spark):
    rows = [(5, "ab cd ef gh", 1), (2, None, 1), (7, "é" * 9, 1), (None, "xyz", 1), (5, "ab cd ef gh", 1), (9, "w " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch int")
    found = fingerprint.edited_and_next(docs, "doc_id", "text").collect()
    order = sorted(((k, t or "") for k, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(
        (str(k), len(t), hashlib.sha256(edited(t, a).encode()).hexdigest()) for (k, t), (_, a) in zip(order, order[1:] + order[:1])
    )
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == want
    assert fingerprint.edited_and_next(docs.limit(0), "doc_id", "text").count() == 0
    one = fingerprint.edited_and_next(docs.filter("doc_id = 7"), "doc_id", "text").first()
    assert one.near_next == one.near_edited == pytest.approx(1.0)
