"""Model work over the embeddings and the event manifest, batch and streaming."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from labelproof.functions.images import image_hash
from labelproof.ml import models as ml
from labelproof.operators import evaluation as ev
from labelproof.plans import gallery
from labelproof.plans.bindings import CLASSES, SPLIT_SEED, manifest, split_label
from labelproof.plans.file_queries import SQL_AWKWARD
from labelproof.plans.registry import query
from labelproof.schemas import Tables
from labelproof.session import scratch_path
from labelproof.sources.files import read_images
from labelproof.streaming import flows

KEYS = ["vec_id"]


def vectors(t: Tables):
    """Embeddings with an entity (vec_id modulo 40) and its split."""
    return t.embeddings.withColumn("entity", F.col("vec_id") % 40).withColumn("split", split_label(SPLIT_SEED, "entity"))


def fitted(t: Tables) -> PipelineModel:
    """The reference fit; queries that score with it pay for it."""

    def fit() -> PipelineModel:
        train = vectors(t).filter("split = 'train'").select("vec_id", "label", "embedding").persist()
        model = ml.fit_classifier(train, "label", "embedding", ml.Experiment("reference", max_iter=500))
        train.unpersist()
        return model

    return t.once("fit", fit)


SQL_VECTORS = f"""vectors AS (SELECT vec_id, label, CASE WHEN d < 70 THEN 'train' WHEN d < 85 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT vec_id, label, ('0x' || substr(sha256('{SPLIT_SEED}|' || (vec_id % 40)::VARCHAR), 1, 8))::BIGINT % 100 AS d FROM embeddings))"""


@query(
    "k1_label_encoding",
    "WITH {manifest} SELECT item_id, target, CASE target WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS label_index FROM manifest",
)
def k1(t):
    rows = manifest(t).select("item_id", "target", "split")
    encoder = ml.encode_labels(rows.filter("split = 'train'"), "target")
    return encoder.transform(rows).select("item_id", "target", F.col("label_index").cast("int").alias("label_index"))


@query(
    "k2_majority_baseline",
    """WITH {manifest}, m AS (SELECT target FROM manifest WHERE split = 'train' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1),
    v AS (SELECT target, (SELECT target FROM m) AS p FROM manifest WHERE split = 'validation'), c AS (SELECT unnest(['click','error','purchase','signup','view']) AS label),
    o AS (SELECT label, (SELECT count(*) FROM v WHERE v.target = label AND p = label) AS tp, (SELECT count(*) FROM v WHERE v.target <> label AND p = label) AS fp, (SELECT count(*) FROM v WHERE v.target = label AND p <> label) AS fn FROM c)
    SELECT label, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1, (tp + fn)::BIGINT AS support FROM o""",
)
def k2(t):
    rows = manifest(t).select("item_id", "target", "split")
    guessed = ml.majority_predictions(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), "target")
    return ev.class_report(guessed, CLASSES, truth="target", predicted="predicted")


@query("k4_logistic_regression")
def k4(t):
    model = fitted(t)
    top = ev.headline(ml.score(vectors(t).filter("split = 'validation'"), model, KEYS, "label", 0.6), ml.class_order(model))
    return top


# a fit counts as done below this slope of the loss
SLOPE = 1e-3


@query(
    "k4_certified_fit",
    "WITH " + SQL_VECTORS + " SELECT count(*)::BIGINT AS rows, count(DISTINCT label)::BIGINT AS classes, 64 * count(DISTINCT label)::BIGINT AS weights, TRUE AS at_optimum FROM vectors WHERE split = 'train'",
)
def k4_certified(t):
    """The fit is checked by the slope of its loss over all training rows, whatever steps led to it."""
    model, train = fitted(t), vectors(t).filter("split = 'train'")
    slope = ml.gradient_norm(train, model, "label")
    classifier = model.stages[1]
    return train.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(classifier.numClasses).cast("bigint").alias("classes"),
        F.lit(classifier.coefficientMatrix.numRows * classifier.coefficientMatrix.numCols).cast("bigint").alias("weights"),
        F.lit(slope <= SLOPE).alias("at_optimum"),
    )


@query("k5_batch_scoring")
def k5(t):
    return ml.score(vectors(t).filter("split = 'test'"), fitted(t), KEYS, "label", 0.6).drop("probabilities")


EXPERIMENTS = (
    ml.Experiment("reference", max_iter=500),
    ml.Experiment("half the dimensions", max_iter=500, dimensions=32),
    ml.Experiment("stronger regularisation", c=0.2, max_iter=500),
)


@query("k6_experiment_grid")
def k6(t):
    ml.check_experiments(EXPERIMENTS)
    rows = vectors(t)
    table = ml.run_grid(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), "label", "embedding", EXPERIMENTS, KEYS)
    return table.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "run_order")


@query(
    "k6_certified_grid",
    "WITH " + SQL_VECTORS + """ SELECT unnest([1, 2, 3])::INT AS run_order, unnest(['reference', 'half the dimensions', 'stronger regularisation']) AS run_name,
    count(*)::BIGINT AS rows, TRUE AS at_optimum FROM vectors WHERE split = 'validation'""",
)
def k6_certified(t):
    """Every run of the grid ends at the optimum of its own loss."""
    return k6(t).select("run_order", "run_name", "rows", (F.col("gradient_norm") <= SLOPE).alias("at_optimum"))


@query("k7_reload_check", "WITH " + SQL_VECTORS + " SELECT vec_id, '' AS problem, TRUE AS unchanged, (SELECT count(DISTINCT label) FROM vectors WHERE split = 'train')::INT AS classes FROM vectors WHERE split = 'validation'")
def k7(t):
    path = scratch_path(t.spark, "model")
    return ml.reload_check(fitted(t), path, vectors(t).filter("split = 'validation'"), KEYS, "label")


@query("m1_feature_stage", "SELECT vec_id, len(embedding) AS values, embedding[1]::DOUBLE AS first_value FROM embeddings")
def m1(t):
    from pyspark.ml.functions import vector_to_array

    staged = ml.VectorFeatures("embedding", "features").transform(t.embeddings)
    values = vector_to_array("features")
    return staged.select("vec_id", F.size(values).cast("bigint").alias("values"), F.element_at(values, 1).alias("first_value"))


@query(
    "m1_feature_stage_pictures",
    "WITH " + gallery.SQL_GALLERY + " SELECT 'v' || vec_id || '.png' AS name, ((32 // 8 - 1) * (32 // 8 - 1) * 4 * 9)::INT AS values FROM gallery WHERE NOT missing AND NOT damaged",
)
def m1_pictures(t):
    from pyspark.ml.functions import vector_to_array

    images = read_images(t.spark, gallery.folder(t)).filter("decoded")
    rows = images.select("path", F.struct("pixels", "height", "width", "channels").alias("picture"))
    staged = ml.VectorFeatures("picture", "features", width=32, height=32, cell=8).transform(rows)
    return staged.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.size(vector_to_array("features")).alias("values"))


def centroid_factory(centroids):
    """Factory of a nearest-centroid model: loads once per worker, scores batches."""

    def load():
        import numpy as np

        table = np.asarray(centroids, dtype=np.float64)

        def probabilities(batch):
            x = np.asarray(batch, dtype=np.float64)
            scores = -((x[:, None, :] - table[None, :, :]) ** 2).sum(axis=2) * 10
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return probabilities

    return load


def centroids(t: Tables, rows=None):
    """Mean training vector per label: one row per (label, dimension) after a map-side combine."""
    parts = (vectors(t) if rows is None else rows).filter("split = 'train'").select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    rows = means.select(F.col("label").cast("string").alias("label"), F.col("c.m").alias("c")).orderBy("label").collect()
    return [r["label"] for r in rows], [r["c"] for r in rows]


@query("m3_prediction_interface")
def m3(t):
    """The same call scores with a Spark pipeline and with an external batch model."""
    rows = vectors(t).filter("split = 'test'")
    labels, table = centroids(t)
    a = ml.predict(rows, fitted(t), KEYS, "label", 0.6).withColumn("model", F.lit("pipeline"))
    b = ml.predict(rows, centroid_factory(table), KEYS, "label", 0.6, classes=labels, features="embedding", width=64).withColumn("model", F.lit("centroid"))
    return a.unionByName(b).drop("probabilities")


SQL_QUARTERS = f"""v AS (SELECT vec_id, vec_id % 40 AS entity, 2 * (embedding[1] > 0)::INT + (embedding[2] > 0)::INT AS truth, embedding,
    CASE WHEN d < 70 THEN 'train' WHEN d < 85 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, ('0x' || substr(sha256('{SPLIT_SEED}|' || (vec_id % 40)::VARCHAR), 1, 8))::BIGINT % 100 AS d FROM embeddings)),
  parts AS (SELECT vec_id, entity, split, truth, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM v),
  means AS (SELECT truth AS cls, i, avg(x) AS m FROM parts WHERE split = 'train' GROUP BY 1, 2),
  near AS (SELECT vec_id, entity, split, truth, cls, -40 * sum((x - m) * (x - m)) AS s FROM parts JOIN means USING (i) WHERE split <> 'train' GROUP BY ALL),
  raised AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM near),
  shares AS (SELECT vec_id, entity, split, truth, cls, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM raised),
  preds AS (SELECT vec_id, entity, split, truth, arg_max(cls, p) AS predicted, max(p) AS confidence, arg_max(cls, p) = truth AS correct FROM shares GROUP BY vec_id, entity, split, truth)"""


def quarters(t: Tables):
    """Vectors labelled by the signs of their first two numbers: a target that can be learned."""
    sign = [(F.get("embedding", i) > 0).cast("int") for i in (0, 1)]
    return vectors(t).withColumn("label", (2 * sign[0] + sign[1]).cast("string"))


SQL_CENTROID_SCORES = "WITH " + SQL_VECTORS + """, parts AS (SELECT e.vec_id, e.label AS truth, v.split, unnest(range(len(e.embedding))) AS i, unnest(e.embedding)::DOUBLE AS x
    FROM embeddings e JOIN vectors v ON v.vec_id = e.vec_id),
  means AS (SELECT truth AS cls, i, avg(x) AS m FROM parts WHERE split = 'train' GROUP BY 1, 2),
  near AS (SELECT vec_id, split, truth, cls, -10 * sum((x - m) * (x - m)) AS s FROM parts JOIN means USING (i) WHERE split <> 'train' GROUP BY 1, 2, 3, 4),
  raised AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM near),
  shares AS (SELECT vec_id, split, truth, cls, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM raised)"""
SQL_CENTROID = SQL_CENTROID_SCORES + """
  SELECT vec_id, truth::VARCHAR AS truth, arg_max(cls, p)::VARCHAR AS predicted, round(max(p), 6) AS confidence, max(p) < 0.6 AS uncertain, arg_max(cls, p) = truth AS correct
  FROM shares WHERE split = 'test' GROUP BY vec_id, truth"""


def by_centroid(t: Tables, rows):
    labels, table = centroids(t)
    scored = ml.predict(rows, centroid_factory(table), KEYS, "label", 0.6, classes=labels, features="embedding", width=64)
    return scored.withColumn("confidence", F.round("confidence", 6)).drop("probabilities")


@query(
    "m3_external_model_dirty",
    SQL_CENTROID_SCORES + """ SELECT vec_id, truth::VARCHAR AS truth, CASE WHEN vec_id % 7 <> 1 THEN round(max(p), 6) END AS confidence, vec_id % 7 = 1 OR max(p) < 0.15 AS uncertain
  FROM shares WHERE split = 'test' GROUP BY vec_id, truth""",
)
def m3_dirty(t):
    """Vectors with a number missing have no confidence, and so are uncertain at any threshold."""
    rows = vectors(t).filter("split = 'test'")
    holed = F.transform("embedding", lambda v, i: F.when((i == 3) & (F.col("vec_id") % 7 == 1), F.lit(float("nan"))).otherwise(v))
    labels, table = centroids(t)
    broken = rows.withColumn("embedding", holed.cast("array<float>"))
    scored = ml.predict(broken, centroid_factory(table), KEYS, "label", 0.15, classes=labels, features="embedding", width=64)
    known = F.nanvl(F.round("confidence", 6), F.lit(None).cast("double"))
    return scored.select("vec_id", "truth", known.alias("confidence"), "uncertain")


@query("m3_external_model", SQL_CENTROID)
def m3_external(t):
    return by_centroid(t, vectors(t).filter("split = 'test'"))


# --- streams -----------------------------------------------------------------


@query("l2_streaming_external_model", SQL_CENTROID)
def l2_external(t):
    """Rows that arrive in a stream get the scores of the batch."""
    source, path, checkpoint = (scratch_path(t.spark, n) for n in ("arriving", "scored", "stream"))
    rows = vectors(t).filter("split = 'test'").select("vec_id", "label", "embedding")
    rows.write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    flows.to_files(by_centroid(t, stream), path, checkpoint).awaitTermination()
    return t.spark.read.parquet(path)


@query(
    "l1_streaming_admission",
    "WITH " + gallery.SQL_GALLERY + """ SELECT vec_id, CASE WHEN damaged THEN 'unsupported type' WHEN blank THEN 'blank or nearly blank' ELSE '' END AS reason,
    NOT damaged AND NOT blank AS admitted FROM gallery WHERE NOT missing""",
)
def l1(t):
    path, checkpoint = scratch_path(t.spark, "judged"), scratch_path(t.spark, "stream")
    flows.admission(flows.arriving_files(t.spark, gallery.folder(t)), path, checkpoint).awaitTermination()
    return flows.judged_files(t.spark, path).select(gallery.key_of().alias("vec_id"), "reason", "admitted")


@query("l1_streaming_admission_by_header", SQL_AWKWARD)
def l1_by_header(t):
    """The reasons of the batch, from the same bytes; several batches."""
    path, checkpoint = scratch_path(t.spark, "judged"), scratch_path(t.spark, "stream")
    files = flows.arriving_files(t.spark, gallery.awkward_folder(t), 1000)
    limits = {"max_bytes": gallery.AWKWARD_BYTES, "max_pixels": gallery.AWKWARD_PIXELS}
    flows.admission(files, path, checkpoint, **limits).awaitTermination()
    return flows.judged_files(t.spark, path).select(gallery.key_of().alias("vec_id"), "reason", "admitted", "width", "height")


@query("l2_streaming_scoring")
def l2(t):
    source = scratch_path(t.spark, "arriving")
    rows = vectors(t).filter("split = 'test'").select("vec_id", "label", "embedding")
    rows.write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    path, checkpoint = scratch_path(t.spark, "scored"), scratch_path(t.spark, "stream")
    flows.to_files(flows.scored(stream, fitted(t), KEYS, "label", 0.6), path, checkpoint).awaitTermination()
    return t.spark.read.parquet(path).drop("probabilities")


@query("c11_image_hash")
def c11_images(t):
    images = read_images(t.spark, gallery.folder(t)).filter("decoded").withColumn("bands", image_hash())
    return images.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.array_join(F.transform("bands", lambda b: F.hex(b)), "-").alias("hash"))
