from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelproof.ml import models as ml
from labelproof.plans.model_queries import centroid_factory


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id") % 3
    noise = (F.col("id") * 7919 % 100) / 400.0
    x = F.array(*[(F.when(k == i, 1.0).otherwise(0.0) + noise).cast("float") for i in range(3)])
    return spark.range(300).select("id", F.element_at(F.array(F.lit("c"), F.lit("a"), F.lit("b")), (k + 1).cast("int")).alias("label"), x.alias("x")).cache()


def test_fit_score_and_reload(spark, rows, tmp_path):
    model = ml.fit_classifier(rows, "label", "x", ml.Experiment("r"))
    assert ml.class_order(model) == ["a", "b", "c"]
    out = ml.score(rows, model, ["id"], "label", 0.6)
    assert out.filter("correct").count() == 300
    assert out.filter("size(probabilities) = 3").count() == 300
    check = ml.reload_check(model, str(tmp_path / "m"), rows.limit(5), ["id"], "label")
    assert {tuple(r)[1:] for r in check.collect()} == {("", True, 3)}


def test_unknown_class_is_scored_as_wrong(rows):
    model = ml.fit_classifier(rows.filter("label <> 'c'"), "label", "x", ml.Experiment("r"))
    out = ml.score(rows, model, ["id"], "label", 0.0)
    assert out.count() == 300 and out.filter("truth = 'c' AND correct").count() == 0


def test_external_model(rows):
    table = [[0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]
    out = ml.predict(rows, centroid_factory(table), ["id"], "label", 0.5, classes=["a", "b", "c"], features="x", width=3)
    assert out.filter("correct").count() == 300
    with pytest.raises(ValueError):
        ml.predict(rows, "cnn", ["id"], "label", 0.5)


def test_majority_tie_is_alphabetic(spark):
    df = spark.createDataFrame([("b",), ("a",)], "t string")
    assert ml.majority_label(df, "t") == "a"
    with pytest.raises(ValueError):
        ml.majority_label(df.limit(0), "t")


def test_encoder_knows_only_training_labels(rows):
    encoder = ml.encode_labels(rows.filter("label <> 'c'"), "label")
    with pytest.raises(Exception, match="[Uu]nseen"):
        encoder.transform(rows).collect()


def test_experiments_change_one_setting():
    ml.check_experiments([ml.Experiment("r"), ml.Experiment("x", c=0.2)])
    with pytest.raises(ValueError, match="'y'"):
        ml.check_experiments([ml.Experiment("r"), ml.Experiment("y", c=0.2, max_iter=5)])


def test_feature_stage_passes_vectors_through(rows, tmp_path):
    from pyspark.ml.functions import vector_to_array

    stage = ml.VectorFeatures("x", "f")
    stage.write().overwrite().save(str(tmp_path / "s"))
    again = ml.VectorFeatures.load(str(tmp_path / "s"))
    out = again.transform(rows).select("x", vector_to_array("f").alias("f"))
    assert out.filter(F.col("x").cast("array<double>") != F.col("f")).count() == 0


def test_gradient_norm_tells_a_finished_fit(rows):
    done = ml.fit_classifier(rows, "label", "x", ml.Experiment("r", max_iter=500, tol=1e-9))
    early = ml.fit_classifier(rows, "label", "x", ml.Experiment("r", max_iter=1))
    assert ml.gradient_norm(rows, done, "label") < 1e-5 < 1e-3 < ml.gradient_norm(rows, early, "label")
    # against differences of the loss in plain numpy
    data = [(r.label, r.x) for r in rows.select("label", "x").collect()]
    x = np.array([v for _, v in data], float)
    y = np.array(["abc".index(name) for name, _ in data])
    classifier = early.stages[1]
    weights, bias = classifier.coefficientMatrix.toArray(), classifier.interceptVector.toArray()

    def loss(w, b):
        scores = x @ w.T + b
        raised = np.log(np.exp(scores).sum(1))
        return (raised - scores[np.arange(len(y)), y]).mean() + classifier.getRegParam() * (w**2).sum() / 2

    slope = []
    for i in range(3):
        for j in range(4):
            push = np.zeros((3, 4))
            push[i, j] = 1e-5
            up, down = (loss(weights + s * push[:, :3], bias + s * push[:, 3]) for s in (1, -1))
            slope.append((up - down) / 2e-5)
    assert ml.gradient_norm(rows, early, "label") == pytest.approx(np.sqrt((np.array(slope) ** 2).sum()), rel=1e-4)
