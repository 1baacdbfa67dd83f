"""The field against enumeration of all markings, its slopes against differences, and held-out accuracy."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelproof.llm import line_quality, queries

MEASURES = len(line_quality.MEASURES)


def random_field(rng, bins=3):
    edges = [np.array([0.3, 0.6]) for _ in range(MEASURES)]
    return line_quality.LineField(edges, rng.normal(size=(3 * MEASURES, bins + 1)), rng.normal(size=2), 0.3)


def chains(rng, field, sizes):
    sizes = np.array(sizes)
    return line_quality.Chains.of(sizes, field.binned(rng.random((sizes.sum(), MEASURES))), field.none)


def markings(field, odds):
    """(marking, log weight) of every way to mark one text's lines."""
    for marks in itertools.product((0, 1), repeat=len(odds)):
        weight = sum(o for o, m in zip(odds, marks) if m)
        weight += sum(field.stay[a] for a, b in zip(marks, marks[1:]) if a == b)
        yield np.array(marks), weight


@pytest.mark.parametrize("seed", range(5))
def test_marginals_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    field = random_field(rng)
    texts = chains(rng, field, [1, 4, 7, 2])
    odds, got = field.odds(texts), field.good(texts)
    for start, size in zip(texts.starts, texts.sizes):
        ways = list(markings(field, odds[start : start + size]))
        weights = np.exp([w for _, w in ways])
        want = (np.stack([m for m, _ in ways]) * weights[:, None]).sum(0) / weights.sum()
        assert np.allclose(got[start : start + size], want)


def test_likelihood_and_slopes():
    rng = np.random.default_rng(7)
    field = random_field(rng)
    texts = chains(rng, field, [3, 1, 5])
    good = rng.integers(0, 2, 9).astype(float)
    by_weight, by_stay, by_prior, likelihood = line_quality.gradient(field, texts, good)
    want = 0.0
    for start, size in zip(texts.starts, texts.sizes):
        ways = list(markings(field, field.odds(texts)[start : start + size]))
        own = next(w for m, w in ways if (m == good[start : start + size]).all())
        want += own - np.log(np.exp([w for _, w in ways]).sum())
    assert likelihood == pytest.approx(want)

    def moved(weight, stay, prior):
        other = line_quality.LineField(field.edges, field.weights + weight, field.stay + stay, field.prior + prior)
        return line_quality.gradient(other, texts, good)[3]

    step = 1e-5
    for place in [(0, 0), (5, 1), (3 * MEASURES - 1, field.none)]:
        push = np.zeros_like(field.weights)
        push[place] = step
        assert (moved(push, 0, 0) - moved(-push, 0, 0)) / (2 * step) == pytest.approx(by_weight[place], abs=1e-4)
    for i in range(2):
        push = np.eye(2)[i] * step
        assert (moved(0, push, 0) - moved(0, -push, 0)) / (2 * step) == pytest.approx(by_stay[i], abs=1e-4)
    assert (moved(0, 0, step) - moved(0, 0, -step)) / (2 * step) == pytest.approx(by_prior, abs=1e-4)


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    found = queries.QUERIES["op11_quality_classifier"](spark, folder)
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    judged = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    right, total = judged.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.count("*")).first()
    assert total > 60 and right >= 0.95


GOOD = "the people of the town went to see the river.\nthey came back with many stories to tell.\n"
BAD = "### $$$ BUY|NOW ### $$$\n@@@ >>> CLICK|HERE <<< @@@\n"


def rows(spark):
    data = [(i, (GOOD if i % 2 else BAD) * (1 + i % 4), "s") for i in range(60)]
    data += [(100, None, "s"), (101, "", None), (102, GOOD * 4000, "s"), (103, BAD, "s"), (103, BAD, "s"), (None, GOOD, "s")]
    return spark.createDataFrame(data, "doc_id long, text string, quality string")


def marked(spark):
    data = [(i, i % 2) for i in range(60)] + [(1, 1), (None, 1), (2, None), (999, 0)]
    return spark.createDataFrame(data, "doc_id long, quality int")


def test_rows(spark):
    docs = rows(spark)
    field = line_quality.fit(docs, marked(spark), "doc_id", "text", "quality", F.col("doc_id") < 50)
    found = line_quality.scores(docs, ["doc_id"], "text", field).collect()
    assert len(found) == docs.count()
    got = {r.doc_id: r.score for r in found}
    assert all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(60))
    assert got[100] == got[101] and got[102] > 0.9 and got[103] < 0.1 and got[None] > 0.9
    assert [r.score for r in found if r.doc_id == 103][0] == [r.score for r in found if r.doc_id == 103][1]
    mixed = line_quality.line_marks(GOOD * 4 + BAD * 4, field)
    assert mixed[1][1] > 0.5 > mixed[-3][1]


def test_windows_see_the_lines_beside_them(spark):
    docs = rows(spark).filter("doc_id < 60")
    whole = line_quality.fit(docs, marked(spark), "doc_id", "text", "quality", F.lit(True), steps=20)
    cut = line_quality.fit(docs, marked(spark), "doc_id", "text", "quality", F.lit(True), steps=20, window_lines=2)
    assert whole.weights.shape == cut.weights.shape
    assert cut.score([GOOD.encode()])[0] > 0.5 > cut.score([BAD.encode()])[0]


def test_without_labels_and_without_rows(spark):
    docs = rows(spark)
    field = line_quality.fit(docs, marked(spark), "doc_id", "text", "quality", F.lit(False))
    assert {r.score for r in line_quality.scores(docs, ["doc_id"], "text", field).collect()} == {0.5}
    assert line_quality.scores(docs.limit(0), ["doc_id"], "text", field).count() == 0
    one = line_quality.fit(docs, marked(spark).filter("quality = 1"), "doc_id", "text", "quality", F.lit(True))
    assert one.score([GOOD.encode()])[0] > 0.7
