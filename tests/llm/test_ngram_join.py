"""The Jaccard join against brute force; DivideSkip against counting."""

from __future__ import annotations

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from labelproof.llm import ngram_join, packing
from labelproof.llm.components import components

ROOT = Path(__file__).resolve().parents[2]


def brute_force(rows):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().translate(ngram_join.LOWER).split()
        size = min(5, len(words))
        sets[key] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(k, len(sets[k]), find(k)) for k in sets}


def corpus(rng, count):
    """Texts, copies, near copies at all distances, chains of them, and passages shared by many."""
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(3)]
    texts = []
    for _ in range(count):
        kind = rng.randrange(6)
        if kind == 0 or not texts:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30, 80]))))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind == 2:
            texts.append(" ".join(rng.sample(passages, 2)) + " " + rng.choice(words))
        else:
            near = rng.choice(texts[-6:]).split()
            for _ in range(rng.choice([1, 1, 2, 3])):
                if near:
                    near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near).upper())
    return list(enumerate(texts))


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    for chunk, frequent, block in ((1_500_000, 64, 256), (900, 3, 4)):
        for name, value in (("CHUNK", chunk), ("FREQUENT", frequent), ("BLOCK", block)):
            monkeypatch.setattr(ngram_join, name, value)
        rows = corpus(rng, 220)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {tuple(r) for r in ngram_join.linked(docs, "doc_id", "text").collect()}
        assert got == brute_force(rows)


def test_divide_skip_counts():
    rng = random.Random(3)
    for _ in range(500):
        lists = [sorted(rng.sample(range(30), rng.randrange(30))) for _ in range(rng.randrange(1, 12))]
        least = rng.randrange(1, 9)
        counts = Counter(i for l in lists for i in l)
        assert ngram_join.divide_skip(lists, least) == {i: c for i, c in counts.items() if c >= least}


def test_many_near_copies_take_few_comparisons(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    compared = []
    links = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, classes: compared.append(pairs.count()) or links(pairs, classes))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in ngram_join.linked(docs, "doc_id", "text").collect()} == {0}
    assert sum(compared) < 300 * 299 / 2 / 4


def test_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, text, 1), (5, text, 1), (3, text.upper(), 1), (1, None, 1), (2, "", 1), (4, " \n", 1), (6, "word " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted(tuple(r) for r in ngram_join.linked(docs, "doc_id", "text").collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 3, 3), (4, 0, 4), (5, 3, 3), (5, 3, 3), (6, 1, 6)]
    kept = ngram_join.representatives(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6]
    twice = docs.filter("doc_id = 5").withColumn("text", F.lit("one two three four five"))
    assert [r.doc_id for r in ngram_join.representatives(twice, "doc_id", "text").collect()] == [5]
    assert ngram_join.linked(docs.limit(0), "doc_id", "text").count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (packing.unpacked(packing.packed(values)) == values).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200}


HELD = """
import random
import pyarrow as pa
from labelproof.llm import ngram_join
from labelproof.llm.batches import tidy

class Task:
    get = classmethod(lambda cls: cls)
    partitionId = staticmethod(lambda: 0)

def held():
    with open("/proc/self/smaps_rollup") as lines:
        return sum(int(line.split()[1]) for line in lines if line.startswith("Pss_Anon")) / 1024

def batches():
    draw = random.Random(1)
    for _ in range(300):
        texts = [" ".join(str(draw.randrange(150_000)) for _ in range(4_000)) for _ in range(2)]
        yield pa.RecordBatch.from_pydict({"text": texts})

ngram_join.TaskContext = Task
before = held()
run = RUN(lambda rows: ngram_join._sent(rows, 12))
assert sum(b.num_rows for b in run(batches())) > 24
print(held() - before)
"""


def test_a_worker_gives_back_what_a_task_took():
    def held(wrapper):
        run = subprocess.run([sys.executable, "-c", HELD.replace("RUN", wrapper)], cwd=ROOT, capture_output=True, text=True, check=True)
        return float(run.stdout)

    assert held("tidy") + 20 < held("")
