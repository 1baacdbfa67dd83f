"""Model bundles: found by digest, refused when changed, and what the held-out evaluation does with them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelproof.ml import bundles
from labelproof.ml import models as ml
from labelproof.operators import protocol

CLASSES = ("a", "b", "c")
SETTINGS = {"scale": 4.0}
BUNDLE = bundles.Bundle("centroid", CLASSES, ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), 4.0)


@pytest.fixture(scope="module")
def items(spark):
    i = F.col("id")
    k = (i % 3).cast("int")
    wrong = i % 10 == 9
    near = F.when(wrong, (k + 1) % 3).otherwise(k)
    x = F.array(*[F.when(near == c, F.lit(1.0)).otherwise(0.0) + (i * 7919 % 100) / 1000.0 for c in range(3)])
    split = F.when(i % 12 < 4, "train").when(i % 12 < 8, "validation").otherwise("test")
    return spark.range(360).select(
        i.alias("item_id"),
        F.concat_ws("-", split, k.cast("string"), (i % 24).cast("string")).alias("entity"),
        F.element_at(F.array(*map(F.lit, CLASSES)), k + 1).alias("label"),
        split.alias("split"),
        x.cast("array<float>").alias("x"),
    ).cache()


def frozen(spark, items, base, bundle=BUNDLE):
    models, paths = str(base / "models"), protocol.Paths(str(base / "run"))
    digest = bundles.publish(spark, bundle, models)
    scored = bundles.score(items.filter("split = 'validation'"), bundle, ["item_id", "entity", "split"], "label", "x", 0.0)
    counts = protocol.held_out_counts(items, entity="entity", target="label", split="split")
    tables = {"items": items.drop("x")}
    record = protocol.prepare(paths, scored, tables, CLASSES, SETTINGS, "m", model_digest=digest, counts=counts)
    return paths, models, record


def evaluate(paths, models, items, **changes):
    options = {"tables": {"items": items.drop("x")}, "classes": CLASSES, "settings": SETTINGS, **changes}
    assignments = items.select("entity", "label", "split").distinct()
    return protocol.evaluate_once(paths, items, assignments, None, target="label", models=models, features="x", **options)


def test_bundles_keep_every_number(spark, tmp_path):
    odd = bundles.Bundle("linear", ("ä", "b"), ((0.1, 1e-300, -0.0), (1 / 3, 2.0**70, 7.0)))
    assert bundles.Bundle.parse(odd.text()) == odd and odd.width == 2
    folder = str(tmp_path / "m")
    assert bundles.publish(spark, odd, folder) == bundles.publish(spark, odd, folder) == odd.digest
    assert bundles.load(spark, folder, odd.digest) == odd
    with pytest.raises(FileNotFoundError):
        bundles.load(spark, folder, "0" * 64)
    part = next((tmp_path / "m" / odd.digest).glob("part-*"))
    (tmp_path / "m" / odd.digest / f".{part.name}.crc").unlink()
    part.write_text(odd.text().replace("7.0", "8.0") + "\n")
    with pytest.raises(AssertionError, match="has changed"):
        bundles.load(spark, folder, odd.digest)
    for broken in (("tree", ("a",), ((1.0,),)), ("linear", ("a", "b"), ((1.0,),)), ("linear", ("a", "b"), ((1.0,), (1.0, 2.0)))):
        with pytest.raises(ValueError):
            bundles.Bundle(*broken)


def test_a_fitted_pipeline_as_bundle(items):
    train = items.filter("split = 'train'")
    model = ml.fit_classifier(train, "label", "x", ml.Experiment("r"))
    both = ml.score(items, model, ["item_id"], "label", 0.5).select("item_id", F.col("probabilities").alias("p")).join(
        bundles.score(items, bundles.from_pipeline(model), ["item_id"], "label", "x", 0.5), "item_id"
    )
    off = F.array_max(F.zip_with("p", "probabilities", lambda a, b: F.abs(a - b)))
    assert both.count() == 360 and both.filter(off > 1e-9).count() == 0


def test_the_frozen_model_scores_the_held_out_rows(spark, items, tmp_path):
    paths, models, record = frozen(spark, items, tmp_path)
    held_out = record.select("held_out").first()[0]
    assert {k: v["rows"] for k, v in held_out.items()} == {"a": 30, "b": 30, "c": 60}
    metrics = evaluate(paths, models, items).first()
    assert metrics["rows"] == 120 and metrics["correct"] == 108 and metrics["total_inference_ms"] > 0
    with pytest.raises(RuntimeError, match="already started"):
        evaluate(paths, models, items)


def test_what_stops_before_the_first_score(spark, items, tmp_path, monkeypatch):
    paths, models, _ = frozen(spark, items, tmp_path)
    scored = []
    real = bundles.score
    monkeypatch.setattr(bundles, "score", lambda *a: scored.append(1) or real(*a))
    with pytest.raises(AssertionError, match="rows and entities per class"):
        evaluate(paths, models, items, expected={"a": (40, 2), "b": (40, 2)})
    with pytest.raises(AssertionError, match="rows and entities per class"):
        evaluate(paths, models, items.filter("item_id <> 8"), tables={"items": items.drop("x")})
    with pytest.raises(FileNotFoundError):
        evaluate(paths, str(tmp_path / "elsewhere"), items)
    with pytest.raises(ValueError, match="must name a model"):
        evaluate(paths, None, items)
    assert not scored and not protocol.exists(spark, paths.receipt("started"))


def test_confidences_that_are_no_number_are_uncertain(spark):
    rows = spark.createDataFrame([(1, "a", [float("nan")] * 3), (2, "a", [1.0, 0.0, 0.0])], "id long, label string, x array<double>")
    found = {r.id: r for r in bundles.score(rows, BUNDLE, ["id"], "label", "x", 0.5).collect()}
    assert found[1].uncertain and not found[2].uncertain and found[2].correct
    # the same rule in the shared last step of all models
    given = rows.withColumn("probabilities", F.col("x"))
    assert [r.uncertain for r in ml.finish(given, CLASSES, ["id"], "label", 0.5).orderBy("id").collect()] == [True, False]
