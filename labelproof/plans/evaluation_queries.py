"""Prediction reports (evaluation, thresholds, mistakes, run comparison)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.operators import evaluation as ev
from labelproof.plans.bindings import CLASSES, history, predictions
from labelproof.plans.registry import query

THRESHOLD = 0.7

SQL_CLASSES = "classes AS (SELECT unnest(['click','error','purchase','signup','view']) AS label)"
SQL_OUTCOMES = """
outcomes AS (
  SELECT c.label,
         count(p.item_id) FILTER (WHERE p.truth = c.label AND p.predicted = c.label)::BIGINT AS tp,
         count(p.item_id) FILTER (WHERE p.truth <> c.label AND p.predicted = c.label)::BIGINT AS fp,
         count(p.item_id) FILTER (WHERE p.truth = c.label AND p.predicted <> c.label)::BIGINT AS fn
  FROM classes c LEFT JOIN scored p ON p.truth = c.label OR p.predicted = c.label
  GROUP BY c.label
),
report AS (
  SELECT label, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision,
         coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1,
         (tp + fn)::BIGINT AS support
  FROM outcomes
)
"""
SQL_REPORT = "WITH {preds}, " + SQL_CLASSES + ", scored AS (SELECT * FROM preds), " + SQL_OUTCOMES


def validation(t):
    return predictions(t).filter(F.col("split") == "validation")


def held_out(t):
    return predictions(t).filter(F.col("split") == "test")


@query(
    "e15_confusion_matrix",
    "WITH {preds}, " + SQL_CLASSES + """
    SELECT a.label AS truth, b.label AS predicted, count(p.item_id)::BIGINT AS rows
    FROM classes a CROSS JOIN classes b
    LEFT JOIN preds p ON p.truth = a.label AND p.predicted = b.label
    GROUP BY a.label, b.label""",
)
def e15(t):
    return ev.confusion_matrix(predictions(t), CLASSES)


@query(
    "e15_confusion_matrix_wide",
    "WITH {preds} SELECT truth, "
    + ", ".join(f"count(*) FILTER (WHERE predicted = '{c}')::BIGINT AS predicted_{c}" for c in CLASSES)
    + " FROM preds GROUP BY truth",
)
def e15w(t):
    return ev.confusion_wide(predictions(t), CLASSES)


@query("e16_class_report", SQL_REPORT + " SELECT * FROM report")
def e16(t):
    return ev.class_report(predictions(t), CLASSES)


@query(
    "e17_macro_f1_fixed_labels",
    "WITH {preds}, " + SQL_CLASSES.replace("'view'", "'view','absent'") + ", scored AS (SELECT * FROM preds), " + SQL_OUTCOMES + """
    SELECT (SELECT count(*) FROM preds)::BIGINT AS rows,
           (SELECT count(*) FROM preds WHERE correct)::BIGINT AS correct,
           (SELECT count(*) FILTER (WHERE correct) / count(*) FROM preds)::DOUBLE AS accuracy,
           round(avg(f1), 9) AS macro_f1, count(*)::BIGINT AS labels FROM report""",
)
def e17_fixed(t):
    out = ev.headline(predictions(t), [*CLASSES, "absent"])
    return out.withColumn("macro_f1", F.round("macro_f1", 9))


@query(
    "e17_macro_f1_seen_labels",
    """WITH {preds}, scored AS (SELECT * FROM preds WHERE truth <> 'view' AND predicted <> 'view'),
    classes AS (SELECT truth AS label FROM scored UNION SELECT predicted FROM scored), """
    + SQL_OUTCOMES
    + """
    SELECT (SELECT count(*) FROM scored)::BIGINT AS rows,
           (SELECT count(*) FROM scored WHERE correct)::BIGINT AS correct,
           (SELECT count(*) FILTER (WHERE correct) / count(*) FROM scored)::DOUBLE AS accuracy,
           round(avg(f1), 9) AS macro_f1, count(*)::BIGINT AS labels FROM report""",
)
def e17_seen(t):
    scored = predictions(t).filter("truth <> 'view' AND predicted <> 'view'")
    return ev.headline(scored).withColumn("macro_f1", F.round("macro_f1", 9))


@query(
    "e18_full_report",
    SQL_REPORT
    + """, acc AS (SELECT count(*) FILTER (WHERE correct) / count(*) AS a, count(*)::BIGINT AS n FROM preds),
    allrows AS (
      SELECT * FROM report
      UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM report
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support)::BIGINT FROM report)
    SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM allrows""",
)
def e18(t):
    out = ev.full_report(predictions(t), CLASSES)
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "e19_error_directions",
    """WITH {preds} SELECT truth, predicted, count(*)::BIGINT AS errors FROM preds WHERE NOT correct
    GROUP BY truth, predicted ORDER BY errors DESC, truth, predicted""",
)
def e19(t):
    return ev.error_directions(predictions(t))


SQL_SWEEP = """
sweep AS (
  SELECT t.threshold, count(*)::BIGINT AS rows, count(*) FILTER (WHERE confidence >= threshold)::BIGINT AS accepted,
         count(*) FILTER (WHERE NOT confidence >= threshold)::BIGINT AS uncertain,
         count(*) FILTER (WHERE confidence >= threshold) / count(*) AS coverage,
         count(*) FILTER (WHERE confidence >= threshold AND correct) / nullif(count(*) FILTER (WHERE confidence >= threshold), 0)
           AS accepted_accuracy
  FROM preds, (SELECT unnest([0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9]::DOUBLE[]) AS threshold) t
  WHERE split = 'validation' GROUP BY t.threshold
), ruled AS (
  SELECT *, coalesce(accepted_accuracy >= 0.9 AND coverage >= 0.5, FALSE) AS qualifies FROM sweep
)
"""


@query("e20_threshold_sweep", "WITH {preds}, " + SQL_SWEEP + " SELECT * FROM ruled")
def e20(t):
    return ev.threshold_sweep(validation(t))


def dirty(t):
    """Validation rows of which some have no confidence and some a confidence that is no number."""
    broken = F.when(F.col("item_id") % 7 == 1, F.lit(None)).when(F.col("item_id") % 7 == 2, F.lit(float("nan")))
    return validation(t).withColumn("confidence", broken.otherwise(F.col("confidence")))


@query(
    "e20_threshold_sweep_dirty",
    "WITH {preds}, " + SQL_SWEEP.replace("confidence >= threshold", "(item_id % 7 NOT IN (1, 2) AND confidence >= threshold)") + " SELECT * FROM ruled",
)
def e20_dirty(t):
    return ev.threshold_sweep(dirty(t))


@query(
    "e21_threshold_choice",
    "WITH {preds}, " + SQL_SWEEP + """ SELECT threshold AS selected_threshold, rows, accepted, uncertain, coverage, accepted_accuracy
    FROM ruled WHERE qualifies ORDER BY threshold LIMIT 1""",
)
def e21(t):
    return ev.choose_threshold(ev.threshold_sweep(validation(t)))


@query(
    "e22_confidence_histogram",
    """WITH {preds}, edges AS (
      SELECT unnest([0.0,0.1,0.2,0.30000000000000004,0.4,0.5,0.6000000000000001,0.7000000000000001,0.8,0.9]::DOUBLE[]) AS lo,
             unnest([0.1,0.2,0.30000000000000004,0.4,0.5,0.6000000000000001,0.7000000000000001,0.8,0.9,1.0]::DOUBLE[]) AS hi)
    SELECT lo AS bin_lower, hi AS bin_upper, count(p.item_id)::BIGINT AS predictions,
           count(p.item_id) FILTER (WHERE correct)::BIGINT AS correct_predictions,
           count(p.item_id) FILTER (WHERE NOT correct)::BIGINT AS incorrect_predictions,
           count(p.item_id) FILTER (WHERE correct) / nullif(count(p.item_id), 0) AS accuracy
    FROM edges LEFT JOIN preds p ON confidence >= lo AND (confidence < hi OR (hi = 1.0 AND confidence <= hi))
    GROUP BY lo, hi""",
)
def e22(t):
    return ev.confidence_histogram(predictions(t))


@query(
    "e23_confidence_summary",
    """WITH {preds}, tagged AS (
      SELECT 'all' AS subset, confidence AS c FROM preds
      UNION ALL SELECT CASE WHEN correct THEN 'correct' ELSE 'incorrect' END, confidence FROM preds)
    SELECT subset, count(*)::BIGINT AS count, round(avg(c), 9) AS mean, min(c) AS minimum, max(c) AS maximum,
           round(quantile_cont(c, 0.25), 9) AS q25, round(median(c), 9) AS median, round(quantile_cont(c, 0.75), 9) AS q75
    FROM tagged GROUP BY subset""",
)
def e23(t):
    out = ev.confidence_summary(predictions(t))
    for c in ("mean", "q25", "median", "q75"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query(
    "e23_confidence_summary_dirty",
    """WITH {preds}, tagged AS (
      SELECT unnest(['all', CASE WHEN correct THEN 'correct' ELSE 'incorrect' END]) AS subset, confidence AS c
      FROM preds WHERE split = 'validation' AND item_id % 7 NOT IN (1, 2))
    SELECT subset, count(*)::BIGINT AS count, round(avg(c), 9) AS mean, min(c) AS minimum, max(c) AS maximum,
           round(quantile_cont(c, 0.25), 9) AS q25, round(median(c), 9) AS median, round(quantile_cont(c, 0.75), 9) AS q75
    FROM tagged GROUP BY subset""",
)
def e23_dirty(t):
    """Confidences that are null or no number enter no figure."""
    out = ev.confidence_summary(dirty(t))
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "q25", "median", "q75")})


@query(
    "e24_uncertainty_by_class",
    """WITH {preds} SELECT truth AS label, count(*)::BIGINT AS rows,
      count(*) FILTER (WHERE confidence >= 0.7)::BIGINT AS accepted,
      count(*) FILTER (WHERE confidence < 0.7)::BIGINT AS uncertain,
      count(*) FILTER (WHERE confidence >= 0.7) / count(*) AS coverage,
      count(*) FILTER (WHERE confidence >= 0.7 AND correct)::BIGINT AS accepted_correct,
      count(*) FILTER (WHERE confidence >= 0.7 AND correct) / nullif(count(*) FILTER (WHERE confidence >= 0.7), 0) AS accepted_accuracy
    FROM preds WHERE split = 'test' GROUP BY truth""",
)
def e24(t):
    return ev.uncertainty_by_class(held_out(t), THRESHOLD, CLASSES)


@query(
    "e25_overall_result",
    """WITH {preds} SELECT count(*)::BIGINT AS rows, count(DISTINCT entity)::BIGINT AS entities,
      count(*) FILTER (WHERE correct)::BIGINT AS correct, count(*) FILTER (WHERE NOT correct)::BIGINT AS incorrect,
      count(*) FILTER (WHERE correct) / count(*) AS accuracy,
      count(*) FILTER (WHERE confidence >= 0.7)::BIGINT AS accepted, count(*) FILTER (WHERE confidence < 0.7)::BIGINT AS uncertain,
      count(*) FILTER (WHERE confidence >= 0.7) / count(*) AS coverage,
      count(*) FILTER (WHERE confidence < 0.7) / count(*) AS uncertain_rate,
      count(*) FILTER (WHERE confidence >= 0.7 AND correct) / nullif(count(*) FILTER (WHERE confidence >= 0.7), 0) AS accepted_accuracy,
      count(*) FILTER (WHERE NOT correct AND confidence >= 0.7)::BIGINT AS confident_mistakes,
      count(*) FILTER (WHERE NOT correct AND confidence < 0.7)::BIGINT AS low_confidence_mistakes,
      round(avg(inference_ms), 6) AS mean_inference_ms, round(sum(inference_ms), 3) AS total_inference_ms
    FROM preds WHERE split = 'test'""",
)
def e25(t):
    out = ev.overall_result(held_out(t), THRESHOLD)
    return out.withColumn("mean_inference_ms", F.round("mean_inference_ms", 6)).withColumn(
        "total_inference_ms", F.round("total_inference_ms", 3)
    )


@query(
    "f11_early_stop",
    """WITH RECURSIVE {history}, walk AS (
      SELECT run, 1::BIGINT AS epoch, validation_macro_f1 AS best, 1::BIGINT AS best_epoch, 0::BIGINT AS stale
      FROM history WHERE epoch = 1
      UNION ALL
      SELECT w.run, h.epoch,
             CASE WHEN h.validation_macro_f1 > w.best + 1e-4::DOUBLE THEN h.validation_macro_f1 ELSE w.best END,
             CASE WHEN h.validation_macro_f1 > w.best + 1e-4::DOUBLE THEN h.epoch ELSE w.best_epoch END,
             CASE WHEN h.validation_macro_f1 > w.best + 1e-4::DOUBLE THEN 0 ELSE w.stale + 1 END
      FROM walk w JOIN history h ON h.run = w.run AND h.epoch = w.epoch + 1 WHERE w.stale < 4)
    SELECT run, arg_max(best, epoch) AS best_metric, arg_max(best_epoch, epoch) AS best_epoch,
           max(epoch)::BIGINT AS epochs_trained, max(stale) >= 4 AS stopped_early
    FROM walk GROUP BY run""",
)
def f11(t):
    return ev.early_stop(history(t), "run", "epoch", "validation_macro_f1", max_epochs=15)


@query(
    "f12_best_per_run",
    """WITH {history} SELECT run, max(validation_macro_f1) AS best_f1,
    arg_max(epoch, (validation_macro_f1, -epoch))::BIGINT AS best_epoch
    FROM history GROUP BY run ORDER BY best_f1 DESC, run""",
)
def f12(t):
    best = history(t).groupBy("run").agg(
        F.max("validation_macro_f1").alias("best_f1"),
        F.max_by("epoch", F.struct(F.col("validation_macro_f1"), -F.col("epoch"))).alias("best_epoch"),
    )
    return best.orderBy(F.desc("best_f1"), "run")


@query(
    "g5_best_run",
    """WITH {history}, runs AS (SELECT run, max(validation_macro_f1) AS f1, max(validation_accuracy) AS accuracy FROM history GROUP BY run)
    SELECT * FROM runs ORDER BY f1 DESC, accuracy DESC, run LIMIT 1""",
)
def g5(t):
    runs = history(t).groupBy("run").agg(
        F.max("validation_macro_f1").alias("f1"), F.max("validation_accuracy").alias("accuracy")
    )
    return ev.best_run(runs, "f1", "accuracy", "run")


@query(
    "g6_extreme_classes",
    SQL_REPORT
    + """ SELECT (SELECT label FROM report ORDER BY f1 DESC, label LIMIT 1) AS strongest, max(f1) AS strongest_f1,
    (SELECT label FROM report ORDER BY f1, label LIMIT 1) AS weakest, min(f1) AS weakest_f1 FROM report""",
)
def g6(t):
    return ev.extreme_classes(ev.class_report(predictions(t), CLASSES))


@query(
    "g7_confident_mistakes",
    """WITH {preds} SELECT item_id, truth, predicted, confidence FROM preds WHERE NOT correct AND confidence >= 0.7
    ORDER BY confidence DESC, item_id""",
)
def g7_confident(t):
    out = ev.mistakes(predictions(t), THRESHOLD).filter("example_group = 'confident_mistake'")
    return out.select("item_id", "truth", "predicted", "confidence").orderBy(F.desc("confidence"), "item_id")


@query(
    "g7_low_confidence_mistakes",
    """WITH {preds} SELECT item_id, truth, predicted, confidence FROM preds WHERE NOT correct AND confidence < 0.7
    ORDER BY confidence, item_id""",
)
def g7_low(t):
    out = ev.mistakes(predictions(t), THRESHOLD).filter("example_group = 'low_confidence_mistake'")
    return out.select("item_id", "truth", "predicted", "confidence").orderBy("confidence", "item_id")


@query(
    "g7_representative_mistakes",
    """WITH {preds}
    (SELECT item_id, truth, predicted, confidence, 'confident_mistake' AS example_group FROM preds
     WHERE NOT correct AND confidence >= 0.7 ORDER BY confidence DESC, item_id LIMIT 5)
    UNION ALL
    (SELECT item_id, truth, predicted, confidence, 'low_confidence_mistake' FROM preds
     WHERE NOT correct AND confidence < 0.7 ORDER BY confidence, item_id LIMIT 5)""",
)
def g7_examples(t):
    out = ev.representative_mistakes(predictions(t), THRESHOLD, "item_id")
    return out.select("item_id", "truth", "predicted", "confidence", "example_group")


@query(
    "k8_model_comparison",
    """WITH {preds}, models AS (
      SELECT 'argmax' AS model, truth, predicted AS p FROM preds
      UNION ALL SELECT 'always_click', truth, 'click' FROM preds
      UNION ALL SELECT 'by_key', truth, (['click','error','purchase','signup','view'])[(item_id % 5 + 1)::INT] FROM preds)
    SELECT model, count(*)::BIGINT AS rows, count(*) FILTER (WHERE truth = p)::BIGINT AS correct,
           count(*) FILTER (WHERE truth = p) / count(*) AS accuracy
    FROM models GROUP BY model ORDER BY accuracy DESC, model""",
)
def k8(t):
    names = F.array(*[F.lit(c) for c in CLASSES])
    by_key = F.element_at(names, (F.col("item_id") % 5 + 1).cast("int"))
    rows = predictions(t).select(
        "truth",
        F.inline(
            F.array(
                F.struct(F.lit("argmax").alias("model"), F.col("predicted").alias("p")),
                F.struct(F.lit("always_click").alias("model"), F.lit("click").alias("p")),
                F.struct(F.lit("by_key").alias("model"), by_key.alias("p")),
            )
        ),
    )
    scores = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("truth") == F.col("p")).alias("correct")
    )
    return scores.withColumn("accuracy", ev.share(F.col("correct"), F.col("rows"))).orderBy(F.desc("accuracy"), "model")
