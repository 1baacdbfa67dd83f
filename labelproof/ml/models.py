"""Spark ML baselines: encoding, training, scoring, experiment grids, reload checks, prediction interface."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions.vectors import argmax_label, probability_problem
from labelproof.operators import evaluation as ev


class VectorFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Feature stage: numeric arrays pass through as vectors, picture structs become gradient features."""

    width = Param(Params._dummy(), "width", "picture width", TypeConverters.toInt)
    height = Param(Params._dummy(), "height", "picture height", TypeConverters.toInt)
    cell = Param(Params._dummy(), "cell", "cell side", TypeConverters.toInt)

    def __init__(self, inputCol: str = "embedding", outputCol: str = "features", width: int = 32, height: int = 32, cell: int = 8):
        super().__init__()
        self._setDefault(width=32, height=32, cell=8)
        self._set(inputCol=inputCol, outputCol=outputCol, width=width, height=height, cell=cell)

    def _transform(self, df: DataFrame) -> DataFrame:
        source, out = self.getInputCol(), self.getOutputCol()
        kind = df.schema[source].dataType
        if isinstance(kind, T.ArrayType):
            return df.withColumn(out, array_to_vector(F.col(source).cast("array<double>")))
        from labelproof.functions.images import gradient_column

        side = self.getOrDefault(self.cell)
        features = gradient_column(source, self.getOrDefault(self.width), self.getOrDefault(self.height), (side, side))
        return df.withColumn(out, array_to_vector(features.cast("array<double>")))


def encode_labels(train: DataFrame, label: str, out: str = "label_index"):
    """Alphabetic label index fitted on the training rows only."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error").fit(train)


def majority_label(train: DataFrame, label: str) -> str:
    """Most frequent training label, the alphabetically first on ties."""
    top = train.groupBy(label).count().orderBy(F.desc("count"), label).limit(1).first()
    if top is None:
        raise ValueError("no training rows")
    return top[0]


def majority_predictions(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("predicted", F.lit(majority_label(train, label)))


@dataclass(frozen=True)
class Experiment:
    name: str
    c: float = 1.0
    max_iter: int = 100
    tol: float = 1e-4
    dimensions: int | None = None


def fit_classifier(train: DataFrame, label: str, features: str, e: Experiment) -> PipelineModel:
    """Multinomial logistic regression with L2 strength 1 / C, on a label index fitted on train."""
    rows = train.count()
    indexer = encode_labels(train, label)
    model = LogisticRegression(
        featuresCol="features",
        labelCol="label_index",
        maxIter=e.max_iter,
        tol=e.tol,
        regParam=1.0 / (e.c * rows),
        elasticNetParam=0.0,
        standardization=False,
        family="multinomial",
    )
    assembled = VectorFeatures(features, "features")
    classifier = model.fit(indexer.transform(assembled.transform(train)))
    # scoring needs the label order but no label; rows of a class unknown to training still get a score
    return PipelineModel([assembled, classifier, indexer.setHandleInvalid("keep")])


def gradient_norm(train: DataFrame, model: PipelineModel, label: str) -> float:
    """Length of the gradient of the regularised loss at the fitted weights, over all training rows.

    The loss is convex with curvature of at least the regularisation, so the weights lie no further from the optimum
    than this length divided by it, however the fit went. Every task adds up its rows' part as one row of numbers.
    """
    classifier = next(s for s in model.stages if hasattr(s, "coefficientMatrix"))
    weights = classifier.coefficientMatrix.toArray()
    size = weights.shape[0] * (weights.shape[1] + 1)
    scored = model.transform(train).select(
        vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"), F.col("label_index").cast("int").alias("y")
    )

    def parts(batches):
        total, rows = np.zeros(size), 0
        for batch in batches:
            x, p = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            p[np.arange(len(p)), batch.column(2).to_numpy()] -= 1.0
            total += (p.T @ np.column_stack([x, np.ones(len(x))])).ravel()
            rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([rows])], ["part", "rows"])

    found = scored.mapInArrow(parts, "part array<double>, rows bigint").select(F.posexplode("part").alias("i", "v"), "rows")
    # one number per weight
    sums = sorted(found.groupBy("i").agg(F.sum("v").alias("v"), F.sum("rows").alias("n")).collect())
    if not sums or not sums[0]["n"]:
        raise ValueError("no training rows")
    slope = np.array([r["v"] for r in sums]).reshape(len(weights), -1) / sums[0]["n"]
    slope[:, :-1] += classifier.getRegParam() * weights
    return float(np.sqrt((slope**2).sum()))


def class_order(model: PipelineModel) -> list[str]:
    from pyspark.ml.feature import StringIndexerModel

    return next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels


def score(df: DataFrame, model: PipelineModel, keys: Sequence[str], label: str, threshold: float) -> DataFrame:
    """Prediction table of a fitted pipeline with the uncertainty rule applied."""
    classes = class_order(model)
    scored = model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    return finish(scored, classes, keys, label, threshold)


def finish(scored: DataFrame, classes: Sequence[str], keys: Sequence[str], label: str, threshold: float) -> DataFrame:
    p = F.slice(F.col("probabilities"), 1, len(classes))
    out = scored.withColumn("probabilities", p).withColumn("predicted", argmax_label("probabilities", classes))
    confidence = F.array_max("probabilities")
    return out.select(
        *keys,
        F.col(label).cast("string").alias("truth"),
        "predicted",
        confidence.alias("confidence"),
        (~ev.reaches(confidence, threshold)).alias("uncertain"),
        F.col(label).cast("string").eqNullSafe(F.col("predicted")).alias("correct"),
        "probabilities",
    )


def predict(
    df: DataFrame,
    model,
    keys: Sequence[str],
    label: str,
    threshold: float,
    *,
    classes: Sequence[str] | None = None,
    features: str = "features",
    width: int | None = None,
) -> DataFrame:
    """One prediction interface for Spark pipelines and for external batch models.

    An external model is a factory that loads it once per Python worker and
    returns a function from a feature matrix to a probability matrix; ``width``
    is the length of its feature arrays.
    """
    if isinstance(model, PipelineModel):
        return score(df, model, keys, label, threshold)
    if not callable(model) or classes is None or width is None:
        raise ValueError("an external model needs a factory, its class order and its feature width")
    udf = predict_batch_udf(model, return_type=T.ArrayType(T.DoubleType()), batch_size=64, input_tensor_shapes=[[width]])
    scored = df.withColumn("probabilities", udf(F.col(features)))
    return finish(scored, classes, keys, label, threshold)


def run_grid(
    train: DataFrame, validation: DataFrame, label: str, features: str, experiments: Sequence[Experiment], keys: Sequence[str]
) -> DataFrame:
    """Fit every experiment on train, score validation, return the comparison table.

    The loop is over the few configured experiments; every fit and every score
    is a distributed job. Features are cached once per feature setting.
    """
    spark = train.sparkSession
    cached: dict = {}
    rows = []
    for order, e in enumerate(experiments, 1):
        if e.dimensions not in cached:
            cut = F.slice(F.col(features), 1, e.dimensions) if e.dimensions else F.col(features)
            pair = tuple(x.select(*keys, label, cut.alias(features)).persist() for x in (train, validation))
            cached[e.dimensions] = pair
        fit_rows, check_rows = cached[e.dimensions]
        model = fit_classifier(fit_rows, label, features, e)
        top = ev.headline(score(check_rows, model, keys, label, 0.0), class_order(model)).first()
        iterations = model.stages[1].summary.totalIterations
        slope = gradient_norm(fit_rows, model, label)
        rows.append(
            (order, e.name, float(e.c), top["rows"], top["correct"], float(top["accuracy"]), float(top["macro_f1"]), int(iterations), slope)
        )
    for pair in cached.values():
        for frame in pair:
            frame.unpersist()
    return spark.createDataFrame(
        rows, "run_order int, run_name string, c double, rows bigint, correct bigint, accuracy double, macro_f1 double, iterations int, gradient_norm double"
    )


def check_experiments(experiments: Sequence[Experiment]) -> None:
    """Every experiment after the first must differ from it in exactly one setting."""
    first = experiments[0]
    for e in experiments[1:]:
        changed = [f for f in ("c", "max_iter", "tol", "dimensions") if getattr(e, f) != getattr(first, f)]
        if len(changed) != 1:
            raise ValueError(f"experiment {e.name!r} changes {changed or 'nothing'}")


def reload_check(model: PipelineModel, path: str, row: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Save, load and re-score; report per row whether the probabilities are valid and unchanged."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    classes = class_order(again)
    before = score(row, model, keys, label, 0.0).select(*keys, F.col("probabilities").alias("before"))
    after = score(row, again, keys, label, 0.0)
    problem = probability_problem(F.col("probabilities"), F.col("predicted"), classes, 1e-6)
    return after.withColumn("problem", problem).join(before, list(keys)).select(
        *keys, "problem", (F.col("before") == F.col("probabilities")).alias("unchanged"), F.size("probabilities").alias("classes")
    )
