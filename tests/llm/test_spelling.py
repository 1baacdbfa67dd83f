"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from labelproof.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def brute_force(counts: dict[str, int]):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * counts[word] else None
    found = set()
    for word in counts:
        root = word
        while form[root] is not None:
            root = form[root]
        found.add((word, form[word], root, counts[word], len(near[word]), counts.get(form[word])))
    return found


def got(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéßü") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    counts = {}
    for stem in stems:
        counts[stem] = rng.choice([1, 2, 4, 8, 8, 16, 40])
        for _ in range(6):
            i, letter = rng.randrange(len(stem) + 1), rng.choice("abcdeéßü𝒳")
            word = rng.choice([stem[:i] + letter + stem[i:], stem[:i] + letter + stem[i + 1 :], stem[:i] + stem[i + 1 :]])
            if word:
                counts.setdefault(word, rng.choice([1, 2, 3, 4]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute_force(counts)
    assert len({r[2] for r in want}) < len(want)
    # any number of symbols gives the same pairs
    for symbols in (1, 2, 6, 20):
        assert got(spelling.variants(words, symbols=symbols)) == want


def test_a_chain_is_followed_to_its_root(spark):
    counts = {"a" * 4 + "b" * i: 2**i for i in range(9)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = got(spelling.variants(words))
    assert found == brute_force(counts) and {r[2] for r in found} == {"aaaabbbbbbbb"}


def test_counted_words(spark):
    data = [
        (7, "Häuser hÄuser häuser, HÄUSER word-word words", "x"),
        (7, "häuser " * 500, "x"),
        (8, None, "x"),
        (9, "", None),
        (None, "häuser wordy wordy wordy", "x"),
    ] + [(i, "repeated variants", "x") for i in range(300)]
    data.append(data[0])
    docs = spark.createDataFrame(data, "doc_id long, text string, word string")
    want = Counter()
    for doc_id, text, _ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                want[run] += 1
    found = {r.word: r.n for r in spelling.counted_words(docs, "doc_id", "text").collect()}
    assert found == {w: n for w, n in want.items() if n >= 3}
    assert any(len(w) < 8 and w not in ("words", "wordy", "häuser", "hÄuser") for w in want)
    assert got(spelling.variants(spelling.counted_words(docs, "doc_id", "text"))) == brute_force(found)


def test_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.counted_words(docs, "doc_id", "text")).count() == 0


def test_no_join_sends_words_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df, label, store=spelling.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(spelling, "stored", kept)
    words = spark.createDataFrame([("hello", 9), ("hallo", 2), ("hellos", 4)], "word string, n long")
    found = spelling.variants(words)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert got(found) == brute_force({"hello": 9, "hallo": 2, "hellos": 4})
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5
    assert not [p for p in plans if "Broadcast" in p]
