"""Model bundles: a trained model as one text file that the digest of its content names.

A record that holds the digest names the model's every number, whatever happens to the folder: a bundle is read back by
its digest and refused when its content has another one. Models here are a few numbers per class and feature, so a bundle
is one line of JSON; it travels with the scoring function and is parsed once per Python worker.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.ml.models import class_order, finish

KINDS = ("centroid", "linear")


@dataclass(frozen=True)
class Bundle:
    """A model over feature arrays: one row of ``weights`` per class, in the order of ``classes``.

    ``centroid``: the classes' mean vectors; scores are the squared distances times ``-scale``.
    ``linear``: coefficients with the intercept as last number; scores are the sums times ``scale``.
    """

    kind: str
    classes: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    scale: float = 1.0

    def __post_init__(self):
        widths = {len(w) for w in self.weights}
        if self.kind not in KINDS or len(self.weights) != len(self.classes) or len(widths) != 1 or not self.classes:
            raise ValueError(f"a bundle needs a kind of {KINDS} and one row of weights of equal length per class")

    @property
    def width(self) -> int:
        """Length of the feature arrays."""
        return len(self.weights[0]) - (self.kind == "linear")

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    @staticmethod
    def parse(text: str) -> Bundle:
        fields = json.loads(text)
        weights = tuple(tuple(float(x) for x in row) for row in fields["weights"])
        return Bundle(fields["kind"], tuple(fields["classes"]), weights, float(fields["scale"]))


def from_pipeline(model: PipelineModel) -> Bundle:
    """The bundle of a fitted logistic regression."""
    classifier = next(s for s in model.stages if hasattr(s, "coefficientMatrix"))
    rows = np.column_stack([classifier.coefficientMatrix.toArray(), classifier.interceptVector.toArray()])
    return Bundle("linear", tuple(class_order(model)), tuple(map(tuple, rows.tolist())))


def publish(spark: SparkSession, bundle: Bundle, folder: str) -> str:
    """Write a bundle under its digest and return that; one that is there already stays."""
    try:
        spark.createDataFrame([(bundle.text(),)], "value string").coalesce(1).write.text(f"{folder}/{bundle.digest}")
    except AnalysisException as error:
        if "ALREADY_EXISTS" not in (error.getCondition() or ""):
            raise
    return bundle.digest


def load(spark: SparkSession, folder: str, digest: str) -> Bundle:
    """The bundle of a digest; an error where there is none or its content has changed."""
    try:
        text = "\n".join(r.value for r in spark.read.text(f"{folder}/{digest}").limit(2).collect())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no model of digest {digest} in {folder}") from error
    found = hashlib.sha256(text.encode()).hexdigest()
    if found != digest:
        raise AssertionError(f"model {digest} has changed: its content has digest {found}")
    return Bundle.parse(text)


def _factory(text: str):
    """What a worker runs once: parse the bundle, return the function of a feature matrix."""

    def start():
        bundle = Bundle.parse(text)
        table = np.asarray(bundle.weights)

        def probabilities(batch: np.ndarray) -> dict[str, np.ndarray]:
            begun = time.perf_counter()
            x = np.asarray(batch, np.float64).reshape(-1, bundle.width)
            if bundle.kind == "centroid":
                scores = -bundle.scale * ((x[:, None, :] - table[None, :, :]) ** 2).sum(axis=2)
            else:
                scores = bundle.scale * (x @ table[:, :-1].T + table[:, -1])
            raised = np.exp(scores - scores.max(axis=1, keepdims=True))
            shares = raised / raised.sum(axis=1, keepdims=True)
            took = 1000 * (time.perf_counter() - begun) / max(1, len(x))
            return {"probabilities": shares, "inference_ms": np.full(len(x), took)}

        return probabilities

    return start


SCORED = T.StructType(
    [T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("inference_ms", T.DoubleType())]
)


def score(df: DataFrame, bundle: Bundle, keys: Sequence[str], label: str, features: str, threshold: float) -> DataFrame:
    """The prediction table of a bundle, with each row's share of its batch's time."""
    run = predict_batch_udf(_factory(bundle.text()), return_type=SCORED, batch_size=512, input_tensor_shapes=[[bundle.width]])
    scored = df.withColumn("scored", run(F.col(features))).select(
        *[c for c in df.columns if c not in SCORED.names], "scored.*"
    )
    return finish(scored, bundle.classes, [*keys, "inference_ms"], label, threshold)


def scorer(
    bundle: Bundle, keys: Sequence[str], label: str, features: str, threshold: float
) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: score(rows, bundle, keys, label, features, threshold)
