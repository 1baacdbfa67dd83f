"""Line dedup against brute force over all repeated runs."""

from __future__ import annotations

import random
import re

from labelproof.llm import line_dedup, queries


def brute_force(docs, min_words):
    """Texts after deleting all lines in a run of enough words that occurs at an earlier place."""
    rows = sorted({(i, t) for i, t in docs if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, order(r[1])))
    sequences = []
    for _, text in rows:
        lines = text.split("\n")
        sequences.append([(p, l, len(re.findall(line_dedup.WORD, l))) for p, l in enumerate(lines)])
        sequences[-1] = [s for s in sequences[-1] if s[2]]
    earliest, out = {}, {}
    for d, seq in enumerate(sequences):
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if sum(s[2] for s in seq[a:b]) >= min_words:
                    earliest.setdefault(tuple(s[1] for s in seq[a:b]), (d, a))
    for d, (row, seq) in enumerate(zip(rows, sequences)):
        gone = set()
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if sum(s[2] for s in seq[a:b]) < min_words:
                    continue
                first = earliest[tuple(s[1] for s in seq[a:b])]
                if first < (d, a) and not (first[0] == d and a < first[1] + b - a):
                    # one passage is at least gone; blank lines between its ends go with it
                    gone.update(range(seq[a][0], seq[b - 1][0] + 1))
        out[row] = "\n".join(l for p, l in enumerate(row[1].split("\n")) if p not in gone)
    return out


def order(text):
    return 0


def worded(text):
    """Without the blank lines, which say nothing about runs."""
    return tuple(line for line in text.split("\n") if line)


def random_docs(rng, count, most):
    alphabet = ["a", "b b", "c c c", "", "d", "e e e e"]
    return [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randrange(most)))) for i in range(count)]


def test_equals_brute_force(spark):
    rng = random.Random(12)
    for min_words, count, most in ((1, 6, 5), (4, 10, 12), (7, 12, 16), (9, 10, 25)):
        docs = random_docs(rng, count, most)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = {(r.doc_id, worded(r.text)) for r in line_dedup.deduplicated(frame, "doc_id", "text", min_words).collect()}
        want = {(row[0], worded(text)) for row, text in brute_force(docs, min_words).items()}
        assert got == want


def test_rows(spark):
    passage = "\n".join(f"line {i} of the passage with several words in it" for i in range(8))
    rows = [
        (None, passage, 1),
        (1, "own text\n" + passage + "\nown end", 1),
        (1, "own text\n" + passage + "\nown end", 1),
        (2, None, 1),
        (3, "", 1),
        (4, passage, 1),
        (5, "short line\n" * 3000, 1),
        (6, "own text", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, deleted int")
    found = line_dedup.deduplicated(docs, "doc_id", "text")
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert got[None] == [(passage, 8, 0)]
    assert got[1] == [("own text\nown end", 10, 8)] * 2
    assert got[2] == [(None, 0, 0)] and got[3] == [("", 1, 0)]
    assert got[4] == [("", 8, 8)]
    # 26 short lines make a passage, which repeats inside the text: its first copy stays
    assert got[5][0][0].startswith("short line\n" * 26) and got[5][0][2] == 2974
    assert got[6] == [("own text", 1, 0)]
    assert found.columns == ["doc_id", "text", "deleted", "n_lines", "n_removed"]


def test_plan_does_not_grow_with_the_levels(spark):
    docs = spark.createDataFrame(random_docs(random.Random(3), 12, 60), "doc_id long, text string")
    # up to 32 lines a passage, six levels; the driver holds the plan of the last step whole
    plan = line_dedup.deduplicated(docs, "doc_id", "text", 33)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicated(docs, "doc_id", "text").count() == 0


def test_query(spark, folder):
    rows = queries.QUERIES["op8_line_dedup"](spark, folder).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {row[0]: len(text) for row, text in brute_force([t for t in texts if t[1].count("\n") < 60], 51).items()}
    got = {r.doc_id: r.kept_chars for r in rows}
    assert len(got) == len(texts)
    assert {k: got[k] for k in want} == want
