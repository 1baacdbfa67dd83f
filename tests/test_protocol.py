"""Freeze once, evaluate once, and stop when anything recorded has changed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelproof.operators import protocol
from labelproof.sources import files

CLASSES = ["a", "b"]
SETTINGS = {"width": 16.0, "rate": 0.001}


@pytest.fixture(scope="module")
def items(spark):
    i = F.col("id")
    confident = i % 10 < 7
    truth = F.when(i % 2 == 0, "a").otherwise("b")
    other = F.when(i % 2 == 0, "b").otherwise("a")
    predicted = F.when(confident | (i % 20 == 8), truth).otherwise(other)
    confidence = F.when(confident, 0.9).otherwise(0.55)
    split = F.when(i % 3 == 0, "train").when(i % 3 == 1, "validation").otherwise("test")
    p = F.array(*[F.when(predicted == c, confidence).otherwise(1.0 - confidence) for c in CLASSES])
    return (
        spark.range(600)
        .select(
            i.alias("item_id"),
            F.concat_ws("-", split, truth, (i % 5).cast("string")).alias("entity"),
            truth.alias("truth"),
            split.alias("split"),
            predicted.alias("predicted"),
            confidence.alias("confidence"),
            (predicted == truth).alias("correct"),
            F.lit(1.0).alias("inference_ms"),
            p.alias("probabilities"),
        )
        .cache()
    )


def tables(items):
    return {"items": items.select("item_id", "entity", "truth", "split")}


def freeze(items, tmp_path):
    paths = protocol.Paths(str(tmp_path / "run"))
    record = protocol.prepare(paths, items.filter("split = 'validation'"), tables(items), CLASSES, SETTINGS, "m")
    return paths, record


def evaluate(paths, items, scorer=lambda rows: rows, **changes):
    options = {"tables": tables(items), "classes": CLASSES, "settings": SETTINGS, **changes}
    assignments = items.select("entity", "truth", "split").distinct()
    return protocol.evaluate_once(paths, items, assignments, scorer, **options)


def test_run_once(spark, items, tmp_path):
    paths, record = freeze(items, tmp_path)
    assert record.select("threshold.selected_threshold").first()[0] == 0.6
    metrics = evaluate(paths, items).first()
    assert metrics["rows"] == 200 and metrics["accepted"] == 140 and metrics["accepted_accuracy"] == 1.0
    assert spark.read.json(paths.receipt("completed")).first()["rows"] == 200
    assert spark.read.option("header", True).csv(paths.report("classification_report")).count() == 2
    with pytest.raises(RuntimeError, match="already started"):
        evaluate(paths, items)
    with pytest.raises(FileExistsError):
        protocol.prepare(paths, items.filter("split = 'validation'"), tables(items), CLASSES, SETTINGS, "m")


def test_changes_stop_before_scoring(spark, items, tmp_path):
    paths, _ = freeze(items, tmp_path)
    scored = []

    def spy(rows):
        scored.append(1)
        return rows

    moved = {"items": items.withColumn("split", F.lit("test")).select("item_id", "entity", "truth", "split")}
    with pytest.raises(AssertionError, match="digest items"):
        evaluate(paths, items, spy, tables=moved)
    with pytest.raises(AssertionError, match="class order"):
        evaluate(paths, items, spy, classes=["b", "a"])
    with pytest.raises(AssertionError, match="settings"):
        evaluate(paths, items, spy, settings={**SETTINGS, "width": 24.0})
    leaking = items.withColumn("entity", F.lit("same"))
    with pytest.raises(AssertionError, match="leakage"):
        evaluate(paths, leaking, spy, tables=tables(items))
    assert not scored and not protocol.exists(spark, paths.receipt("started"))


def test_only_validation_rows_choose_the_threshold(items, tmp_path):
    paths = protocol.Paths(str(tmp_path / "x"))
    with pytest.raises(AssertionError, match="validation rows only"):
        protocol.prepare(paths, items, tables(items), CLASSES, SETTINGS, "m")
    broken = items.filter("split = 'validation'").withColumn("predicted", F.lit("a"))
    with pytest.raises(AssertionError, match="invalid probabilities or labels"):
        protocol.prepare(paths, broken, tables(items), CLASSES, SETTINGS, "m")


def test_whole_text_scan(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("First LINE\nsecond\n\xff".encode("latin-1"))
    row = files.read_texts(spark, str(tmp_path)).first()
    assert row["text"].startswith("first line\nsecond")


def test_wrong_counts_stop_before_scoring(spark, items, tmp_path):
    paths, _ = freeze(items, tmp_path)
    held_out = items.filter("split = 'test'")
    counts = {r["truth"]: (r["n"], r["e"]) for r in held_out.groupBy("truth").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("e")).collect()}
    protocol.check_counts(held_out, counts, entity="entity", target="truth")
    name = next(iter(counts))
    wrong = {**counts, name: (counts[name][0] + 1, counts[name][1])}
    with pytest.raises(AssertionError, match="rows and entities per class"):
        protocol.evaluate_once(
            paths, items, items.select("entity", "truth", "split").distinct(), lambda rows: rows, tables(items), CLASSES, SETTINGS, expected=wrong
        )
    assert not protocol.exists(spark, paths.receipt("started"))
