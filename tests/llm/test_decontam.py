"""Decontamination against brute force and on awkward rows."""

from __future__ import annotations

import random

from labelproof.llm import decontam


def brute_force(text, items, window):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for number, item in enumerate(items):
        size = min(window, len(item))
        if not size:
            continue
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(number)
    return len(words), hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        alphabet = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])]
        items = [[rng.choice(alphabet) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(5))]
        text = b" ".join(rng.choice([*alphabet, b"x"]) for _ in range(rng.randrange(40)))
        automaton = decontam.ItemAutomaton(items, 4)
        n, spans, found = automaton.hits(text)
        want = brute_force(text, items, 4)
        assert (n, {i for a, b in spans for i in range(a, b)}, found) == want


def frames(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [
        (1, f"Intro, {item.upper()}! end", "x"),
        (2, None, None),
        (3, "", "x"),
        (4, "clean words " * 3000, None),
        (4, "clean words " * 3000, None),
        (5, " ".join(["filler"] * 500) + " " + " ".join(f"w{i}" for i in range(13)), "x"),
        (None, "two words", "x"),
    ]
    items = [(7, item), (8, item), (9, "Two words"), (10, None), (11, "...")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, n_words string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_report_and_blocks(spark):
    docs, items = frames(spark)
    rows = {}
    for block_words in (400_000, 30):
        report = decontam.report(docs, items, "doc_id", "text", "item_id", "text", block_words=block_words)
        rows[block_words] = sorted(
            (str(r.doc_id), r.n_words, r.n_hit, str(r.spans), sorted(r["items"])) for r in report.collect()
        )
    assert rows[400_000] == rows[30]
    by_id = {r[0]: r for r in rows[30]}
    assert by_id["1"][1:3] == (22, 20) and by_id["1"][4] == [7, 8]
    assert by_id["2"][1:3] == by_id["3"][1:3] == (0, 0)
    assert by_id["5"][1:3] == (513, 13)
    assert by_id["None"][4] == [9]
    assert len(rows[30]) == 7


def test_clean_documents_keep_all_columns(spark):
    docs, items = frames(spark)
    for block_words in (400_000, 30):
        clean = decontam.clean_documents(docs, items, "text", "item_id", "text", block_words=block_words)
        assert clean.columns == docs.columns
        assert sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3", "4", "4", "5"]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontam.report(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert decontam.clean_documents(docs, items.limit(0), "text", "item_id", "text").count() == 7


def test_cut_spans():
    assert decontam.cut_spans("One, two. Three! four", [(1, 3)]) == "One, ! four"
    assert decontam.cut_spans("ß ü", [(0, 2)]) == ""
