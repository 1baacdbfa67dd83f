"""Evaluation operators against published aggregate figures and hand-made frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelproof.operators import evaluation as ev

CLASSES = ["display", "handwriting", "monospace", "sans_serif", "serif"]
# Fixed figures of a finished evaluation: confusion matrix rows in class order.
MATRIX = [[119, 0, 0, 0, 1], [9, 110, 1, 0, 0], [0, 0, 115, 4, 1], [0, 0, 24, 79, 17], [0, 0, 20, 3, 97]]
F1 = [0.9596774193548387, 0.9565217391304348, 0.8214285714285714, 0.7669902912621359, 0.8220338983050848]
PRECISION = [0.9296875, 1.0, 0.71875, 0.9186046511627907, 0.8362068965517241]
# Threshold sweep: accepted rows and accuracy among them, of 600 rows.
SWEEP = [(508, 0.8799212598425197), (467, 0.8907922912205567), (431, 0.9071925754060325), (392, 0.9285714285714286),
         (364, 0.9368131868131868), (340, 0.9441176470588235), (313, 0.9616613418530351), (276, 0.967391304347826), (236, 0.9703389830508474)]
HISTORY = {
    "reference": [0.1038, 0.3121, 0.642, 0.4722, 0.6254, 0.6303, 0.6464, 0.5904, 0.7337, 0.6621, 0.6936, 0.681, 0.7748, 0.8331, 0.7032],
    "lower rate": [0.1302, 0.5053, 0.6062, 0.4857, 0.6137, 0.6923, 0.6398, 0.6669, 0.7152, 0.7352, 0.7045, 0.7161, 0.7576, 0.6625, 0.7428],
    "wider": [0.3139, 0.5189, 0.5781, 0.492, 0.6049, 0.5667, 0.6671, 0.7443, 0.7579, 0.6235, 0.6967, 0.5532, 0.7387],
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(CLASSES[i], CLASSES[j]) for i in range(5) for j in range(5) for _ in range(MATRIX[i][j])]
    return spark.createDataFrame(rows, "truth string, predicted string").cache()


def test_report_from_matrix(scored):
    report = {r["label"]: r for r in ev.class_report(scored, CLASSES).collect()}
    for name, f1, precision in zip(CLASSES, F1, PRECISION):
        assert report[name]["f1"] == pytest.approx(f1, abs=1e-15)
        assert report[name]["precision"] == pytest.approx(precision, abs=1e-15)
        assert report[name]["support"] == 120


def test_headline(scored):
    top = ev.headline(scored, CLASSES).first()
    assert top["accuracy"] == pytest.approx(0.8666666666666667)
    assert top["macro_f1"] == pytest.approx(0.86533, abs=1e-5)


def test_matrix_and_error_directions(scored):
    wide = {r["truth"]: [r[f"predicted_{c}"] for c in CLASSES] for r in ev.confusion_wide(scored, CLASSES).collect()}
    assert [wide[c] for c in CLASSES] == MATRIX
    errors = [tuple(r) for r in ev.error_directions(scored).collect()]
    assert errors[:4] == [("sans_serif", "monospace", 24), ("serif", "monospace", 20), ("sans_serif", "serif", 17), ("handwriting", "display", 9)]
    assert len(errors) == 9


def test_label_policies_differ_when_a_class_is_absent(scored):
    fixed = ev.headline(scored, [*CLASSES, "absent"]).first()["macro_f1"]
    seen = ev.headline(scored).first()["macro_f1"]
    assert seen == pytest.approx(fixed * 6 / 5)


def test_majority_report(spark):
    rows = spark.createDataFrame([(c, "display") for c in CLASSES for _ in range(120)], "truth string, predicted string")
    report = {r["label"]: r for r in ev.class_report(rows, CLASSES).collect()}
    assert report["display"]["f1"] == pytest.approx(1 / 3)
    assert all(report[c]["precision"] == report[c]["recall"] == report[c]["f1"] == 0.0 for c in CLASSES[1:])


def sweep_rows(spark):
    """600 rows whose acceptance at each threshold matches the published sweep."""
    good = [round(n * a) for n, a in SWEEP]
    rows = []
    for i, t in enumerate(ev.THRESHOLDS):
        later, later_good = (SWEEP[i + 1][0], good[i + 1]) if i + 1 < len(SWEEP) else (0, 0)
        hits = good[i] - later_good
        rows += [(t + 0.01, k < hits) for k in range(SWEEP[i][0] - later)]
    rows += [(0.4, False)] * (600 - len(rows))
    return spark.createDataFrame(rows, "confidence double, correct boolean")


def test_threshold_sweep_and_choice(spark):
    sweep = ev.threshold_sweep(sweep_rows(spark))
    found = sorted((r["threshold"], r["accepted"], r["accepted_accuracy"], r["qualifies"]) for r in sweep.collect())
    for (t, accepted, accuracy, qualifies), (n, a) in zip(found, SWEEP):
        assert accepted == n and accuracy == pytest.approx(a)
        assert qualifies == (0.6 <= t <= 0.8)
    assert ev.require_threshold(sweep) == 0.6


def test_no_threshold_is_an_error(spark):
    rows = spark.createDataFrame([(0.95, False)] * 10, "confidence double, correct boolean")
    with pytest.raises(RuntimeError, match="no candidate threshold"):
        ev.require_threshold(ev.threshold_sweep(rows))


def test_sweep_without_accepted_rows_has_null_accuracy(spark):
    rows = spark.createDataFrame([(0.1, True)], "confidence double, correct boolean")
    assert all(r["accepted_accuracy"] is None and not r["qualifies"] for r in ev.threshold_sweep(rows).collect())


def test_histogram_edges(spark):
    values = [0.0, 0.3, 0.30000000000000004, 0.6, 0.7, 0.9, 1.0]
    rows = spark.createDataFrame([(v, True) for v in values], "confidence double, correct boolean")
    found = {round(r["bin_lower"], 1): (r["predictions"], r["accuracy"]) for r in ev.confidence_histogram(rows).collect()}
    assert len(found) == 10
    # 0.3, 0.6 and 0.7 lie just below their linspace edges
    assert {b: n for b, (n, _) in found.items() if n} == {0.0: 1, 0.2: 1, 0.3: 1, 0.5: 1, 0.6: 1, 0.9: 2}
    assert found[0.1] == (0, None)


def test_confidence_summary_of_an_empty_outcome(spark):
    rows = spark.createDataFrame([(0.2, True), (0.4, True)], "confidence double, correct boolean")
    out = {r["subset"]: r for r in ev.confidence_summary(rows).collect()}
    assert out["incorrect"]["count"] == 0 and out["incorrect"]["mean"] is None
    assert out["all"]["median"] == pytest.approx(0.3)


def test_early_stop(spark):
    rows = [(run, i + 1, v) for run, values in HISTORY.items() for i, v in enumerate(values)]
    history = spark.createDataFrame(rows, "run string, epoch int, f1 double")
    out = {r["run"]: (r["best_epoch"], r["epochs_trained"], r["stopped_early"]) for r in ev.early_stop(history, "run", "epoch", "f1").collect()}
    assert out == {"reference": (14, 15, False), "lower rate": (13, 15, False), "wider": (9, 13, True)}


def test_long_runs_are_whole_and_overlong_ones_an_error(spark):
    history = spark.range(1202).select(F.lit("r").alias("run"), (F.col("id") + 1).alias("epoch"), (F.col("id") * 0.01).alias("f1"))
    out = ev.early_stop(history, "run", "epoch", "f1").first()
    assert (out["best_epoch"], out["epochs_trained"], out["stopped_early"]) == (1202, 1202, False)
    with pytest.raises(Exception, match="more than 1000 epochs"):
        ev.early_stop(history, "run", "epoch", "f1", max_epochs=1000).collect()


def test_confidence_that_is_no_number_reaches_no_threshold(spark):
    rows = spark.createDataFrame([(0.95, True), (None, True), (float("nan"), True), (0.2, False)], "confidence double, correct boolean")
    out = ev.threshold_sweep(rows, [0.5]).first()
    assert (out["rows"], out["accepted"], out["coverage"]) == (4, 1, 0.25)


def test_best_run_tie_break(spark):
    runs = spark.createDataFrame([(1, 0.5, 0.7), (2, 0.69, 0.6), (3, 0.69, 0.695), (4, 0.69, 0.695)], "run int, f1 double, acc double")
    assert ev.best_run(runs, "f1", "acc", "run").first()["run"] == 3


def test_uncertainty_keeps_absent_classes(spark):
    rows = spark.createDataFrame([("a", 0.9, True), ("a", 0.1, False)], "truth string, confidence double, correct boolean")
    out = {r["label"]: r for r in ev.uncertainty_by_class(rows, 0.5, ["a", "b"]).collect()}
    assert out["a"]["coverage"] == 0.5 and out["a"]["accepted_accuracy"] == 1.0
    assert out["b"]["rows"] == 0 and out["b"]["coverage"] is None


def test_extremes_take_the_first_label_on_ties(spark):
    report = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.5)], "label string, f1 double")
    row = ev.extreme_classes(report).first()
    assert (row["strongest"], row["weakest"]) == ("a", "a")


def test_representative_mistakes(spark):
    rows = spark.range(40).select(
        F.col("id").alias("item_id"), (F.col("id") / 40.0).alias("confidence"), F.lit(False).alias("correct")
    )
    out = ev.representative_mistakes(rows, 0.5, "item_id").collect()
    picked = {g: sorted(r["item_id"] for r in out if r["example_group"] == g) for g in {r["example_group"] for r in out}}
    assert picked == {"confident_mistake": [35, 36, 37, 38, 39], "low_confidence_mistake": [0, 1, 2, 3, 4]}
