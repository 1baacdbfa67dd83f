"""Base spans against plain patterns; the battery on random and structured tokens."""

from __future__ import annotations

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from labelproof.llm import queries, secret_scan

PLAIN = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def plain(text):
    spans = []
    for kind, (pattern, group, least) in PLAIN.items():
        spans += [(kind, *m.span()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(spans, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(6)
    parts = ["secret", "token", "API_key", "ſecret", ":", "=", " ", '"', "abcdefgh", "x1", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "é", "\n", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    texts += [None, "", "token=" + "a1" * 50_000, "ab " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = secret_scan.base_spans(F.coalesce("text", F.lit("")))
    for r in docs.select("doc_id", "text", base.alias("base")).collect():
        got = sorted((tuple(s) for s in r.base), key=lambda s: (s[1], list(PLAIN).index(s[0])))
        assert got == plain(r.text), r.text


def corpus(spark):
    rng = random.Random(9)
    rows, secret = [], {}
    for i in range(300):
        alphabet, size = rng.choice(
            [(string.ascii_letters + string.digits + "+/", 40), ("0123456789ABCDEF", 48), (string.ascii_letters + string.digits, 32)]
        )
        token = "".join(rng.choice(alphabet) for _ in range(size))
        secret[i] = token
        rows.append((i, f"é key {token} end", "x"))
    for i in range(300, 600):
        word = rng.choice(["some_module_name_number_2", "aaaaaaaaaaaaaaaaaaaaaaaa1", "abcabcabcabcabcabcabc123", "path/to/the/file/number/7"])
        rows.append((i, f"see {word} there", "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, base string"), secret


def test_random_tokens_are_found_and_structured_ones_are_not(spark):
    docs, secret = corpus(spark)
    found = {r.doc_id: r.added for r in secret_scan.spans(docs, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = sum(any(texts[i][s.start : s.end] == t for s in found[i]) for i, t in secret.items())
    assert hits >= 280
    assert sum(bool(found[i]) for i in range(300, 600)) <= 3


def test_random_tokens_are_found_in_classes_of_any_size(spark):
    # 120 classes with a single random key each, as they are met one corpus at a time
    rng = random.Random(12)
    letters = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 200))) for _ in range(120)]
    docs = spark.createDataFrame([(i, f"key {k} end") for i, k in enumerate(keys)], "doc_id long, text string")
    scored = docs.select(secret_scan.candidates(F.col("text")).alias("c")).collect()
    found = 0
    for r in scored:
        own = [int(r.c[0].p > cut) for cut in secret_scan.CUTS]
        found += r.c[0].p > secret_scan.chosen_cut(own, [0] * len(own), 0.05)
    assert found >= 114
    # some tens of tokens, nothing structured: p-values are uniform
    kept = total = 0
    for _ in range(300):
        values = [rng.random() for _ in range(rng.choice([1, 3, 10, 40]))]
        own = [sum(v > cut for v in values) for cut in secret_scan.CUTS]
        kept += sum(v > secret_scan.chosen_cut(own, [0] * len(own), 0.05) for v in values)
        total += len(values)
    assert kept >= 0.95 * total
    # structured tokens are still cut off where their number, or that of the neighbours, shows them
    for own, near in (([200, *[40] * 8], [0] * 9), ([3, *[0] * 8], [400, *[10] * 8])):
        assert secret_scan.chosen_cut(own, near, 0.05) > 0.01
    lone = docs.filter("doc_id < 4").collect()
    for r in lone:
        one = secret_scan.spans(spark.createDataFrame([r]), "doc_id", "text").first()
        assert len(one.added) == int(scored[r.doc_id].c[0].p > 0.01)


def test_rows(spark):
    key = "password: hunter2hunter2"
    rows = [(1, key, 1), (1, key, 1), (2, None, 1), (3, "", 1), (None, "AKIA" + "Q" * 16, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, added int")
    found = secret_scan.spans(docs, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in found) == [
        ("1", [("assign", 0, 24)]),
        ("1", [("assign", 0, 24)]),
        ("2", []),
        ("3", []),
        ("None", [("access", 0, 20)]),
    ]
    assert secret_scan.spans(docs.limit(0), "doc_id", "text").count() == 0


def test_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_secret_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in PLAIN]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
