"""Classifier evaluation. Every report starts from one small aggregate of the predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelproof.operators.ranking import exact_quantiles, top_rows
from labelproof.operators.reshape import crosstab, literals
from labelproof.session import one_row

# Fixed values of the acceptance rule: candidates, accuracy floor, coverage floor, histogram edges.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)
MINIMUM_ACCURACY = 0.9
MINIMUM_COVERAGE = 0.5
HISTOGRAM_EDGES = (
    0.0,
    0.1,
    0.2,
    0.30000000000000004,
    0.4,
    0.5,
    0.6000000000000001,
    0.7000000000000001,
    0.8,
    0.9,
    1.0,
)


def _long(column: Column) -> Column:
    return column.cast("bigint")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def confusion_cells(predictions: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Observed (truth, predicted) pairs with counts."""
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def confusion_matrix(predictions: DataFrame, classes: Sequence, **roles: str) -> DataFrame:
    """Long confusion matrix over a fixed class order, empty cells kept as 0."""
    spark = predictions.sparkSession
    grid = literals(spark, classes, "truth").select(
        "truth", F.explode(F.array(*[F.lit(c) for c in classes])).alias("predicted")
    )
    cells = confusion_cells(predictions, **roles)
    return grid.join(cells, ["truth", "predicted"], "left").select(
        "truth", "predicted", _long(F.coalesce("rows", F.lit(0))).alias("rows")
    )


def confusion_wide(predictions: DataFrame, classes: Sequence, **roles: str) -> DataFrame:
    cells = confusion_cells(predictions, **roles)
    return crosstab(cells, "truth", "predicted", classes, F.sum("rows"), prefix="predicted_")


def class_outcomes(predictions: DataFrame, classes: Sequence | None = None, **roles: str) -> DataFrame:
    """True positives, false positives, false negatives and support per class.

    ``classes`` fixes the label set; without it the labels seen in truth or
    prediction are used.
    """
    cells = confusion_cells(predictions, **roles)
    hit = F.col("truth") == F.col("predicted")
    sides = F.array(
        F.struct(
            F.col("truth").alias("label"),
            F.when(hit, F.col("rows")).otherwise(0).alias("tp"),
            F.lit(0).cast("bigint").alias("fp"),
            F.when(hit, 0).otherwise(F.col("rows")).alias("fn"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("bigint").alias("tp"),
            F.when(hit, 0).otherwise(F.col("rows")).alias("fp"),
            F.lit(0).cast("bigint").alias("fn"),
        ),
    )
    summed = (
        cells.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    if classes is not None:
        summed = literals(predictions.sparkSession, classes, "label").join(summed, "label", "left").na.fill(0)
    return summed.select("label", *[_long(F.col(c)).alias(c) for c in ("tp", "fp", "fn")]).withColumn(
        "support", _long(F.col("tp") + F.col("fn"))
    )


def class_report(predictions: DataFrame, classes: Sequence | None = None, **roles: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio is undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return class_outcomes(predictions, classes, **roles).select(
        F.col("label"),
        F.coalesce(share(tp, tp + fp), zero).alias("precision"),
        F.coalesce(share(tp, tp + fn), zero).alias("recall"),
        F.coalesce(share(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        F.col("support"),
    )


def headline(predictions: DataFrame, classes: Sequence | None = None, **roles: str) -> DataFrame:
    """Accuracy and macro F1 over the fixed classes, or over the labels seen."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.coalesce(share(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    hits = confusion_cells(predictions, **roles).agg(
        _long(F.sum("rows")).alias("rows"),
        _long(F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("rows"))), F.lit(0))).alias("correct"),
    )
    macro = class_outcomes(predictions, classes, **roles).agg(
        F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("labels")
    )
    scores = one_row(macro)
    return hits.select(
        "rows",
        "correct",
        share(F.col("correct"), F.col("rows")).alias("accuracy"),
        scores.getField("macro_f1").alias("macro_f1"),
        scores.getField("labels").alias("labels"),
    )


def full_report(predictions: DataFrame, classes: Sequence | None = None, **roles: str) -> DataFrame:
    """Class rows plus accuracy, macro average and weighted average rows."""
    report = class_report(predictions, classes, **roles)
    measures = ("precision", "recall", "f1")
    macro = report.agg(
        F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")
    )
    weighted = report.agg(
        F.lit("weighted avg").alias("label"),
        *[share(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    top = headline(predictions, classes, **roles).select(
        F.lit("accuracy").alias("label"),
        *[F.col("accuracy").alias(m) for m in measures],
        F.col("rows").alias("support"),
    )
    return report.unionByName(top).unionByName(macro).unionByName(weighted)


def error_directions(predictions: DataFrame, **roles: str) -> DataFrame:
    """Wrong (truth, predicted) pairs, most frequent first."""
    wrong = confusion_cells(predictions, **roles).filter(F.col("truth") != F.col("predicted"))
    return wrong.withColumnRenamed("rows", "errors").orderBy(F.desc("errors"), "truth", "predicted")


def reaches(confidence: Column, threshold: float) -> Column:
    """Whether a confidence is a number of at least the threshold; null and NaN reach none."""
    number = confidence.cast("double")
    return F.coalesce((number >= F.lit(float(threshold))) & ~F.isnan(number), F.lit(False))


def threshold_sweep(
    predictions: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    *,
    confidence: str = "confidence",
    correct: str = "correct",
    minimum_accuracy: float = MINIMUM_ACCURACY,
    minimum_coverage: float = MINIMUM_COVERAGE,
) -> DataFrame:
    """Coverage and accuracy of the accepted rows at each candidate threshold.

    A row falls in the bin of the highest threshold it reaches, so the
    predictions are read once whatever the number of candidates; thresholds are
    then suffix sums over at most ``len(thresholds) + 1`` bins.
    """
    reached = F.lit(0)
    for t in thresholds:
        reached = reached + reaches(F.col(confidence), t).cast("int")
    bins = predictions.groupBy(reached.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("good")
    )
    grid = literals(predictions.sparkSession, [0.0, *[float(t) for t in sorted(thresholds)]], "threshold", "bin")
    filled = grid.join(bins, "bin", "left").na.fill(0, ["n", "good"])
    above = W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.currentRow, W.unboundedFollowing)
    sums = filled.select(
        "bin",
        "threshold",
        _long(F.sum("n").over(W.partitionBy(F.lit(0)))).alias("rows"),
        _long(F.sum("n").over(above)).alias("accepted"),
        _long(F.sum("good").over(above)).alias("accepted_correct"),
    ).filter(F.col("bin") > 0)
    out = sums.select(
        "threshold",
        "rows",
        "accepted",
        (F.col("rows") - F.col("accepted")).alias("uncertain"),
        share(F.col("accepted"), F.col("rows")).alias("coverage"),
        share(F.col("accepted_correct"), F.col("accepted")).alias("accepted_accuracy"),
    )
    rule = (F.col("accepted_accuracy") >= minimum_accuracy) & (F.col("coverage") >= minimum_coverage)
    return out.withColumn("qualifies", F.coalesce(rule, F.lit(False)))


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """Lowest qualifying threshold with its figures as one row, all null when none qualifies."""
    columns = [c for c in sweep.columns if c != "qualifies"]
    best = F.min_by(F.struct(*columns), "threshold").alias("best")
    return sweep.filter("qualifies").agg(best).select("best.*").withColumnRenamed("threshold", "selected_threshold")


def require_threshold(sweep: DataFrame) -> float:
    """The chosen threshold as a number; an error when no candidate qualifies."""
    value = choose_threshold(sweep).select("selected_threshold").first()[0]
    if value is None:
        raise RuntimeError("no candidate threshold meets the accuracy and coverage floors")
    return float(value)


def confidence_histogram(
    predictions: DataFrame,
    edges: Sequence[float] = HISTOGRAM_EDGES,
    *,
    confidence: str = "confidence",
    correct: str = "correct",
) -> DataFrame:
    """Half-open bins, the last one closed; empty bins stay with a null accuracy."""
    last = len(edges) - 2
    passed = F.lit(-1)
    for e in edges[:-1]:
        passed = passed + (F.col(confidence) >= F.lit(float(e))).cast("int")
    inside = (F.col(confidence) >= edges[0]) & (F.col(confidence) <= edges[-1])
    counts = (
        predictions.filter(inside)
        .groupBy(passed.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("good"))
    )
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    grid = literals(predictions.sparkSession, list(range(last + 1)), "bin").select(
        "bin",
        F.element_at(bounds, F.col("bin") + 1).alias("bin_lower"),
        F.element_at(bounds, F.col("bin") + 2).alias("bin_upper"),
    )
    return (
        grid.join(counts, "bin", "left")
        .na.fill(0, ["n", "good"])
        .select(
            "bin_lower",
            "bin_upper",
            _long(F.col("n")).alias("predictions"),
            _long(F.col("good")).alias("correct_predictions"),
            _long(F.col("n") - F.col("good")).alias("incorrect_predictions"),
            share(F.col("good"), F.col("n")).alias("accuracy"),
        )
    )


def confidence_summary(
    predictions: DataFrame, *, confidence: str = "confidence", correct: str = "correct"
) -> DataFrame:
    """Count, mean, quartiles, minimum and maximum for all, correct and incorrect rows."""
    outcome = F.when(F.col(correct), "correct").otherwise("incorrect")
    # a confidence that is no number is left out everywhere, as the quartiles leave it out
    number = F.nanvl(F.col(confidence).cast("double"), F.lit(None).cast("double"))
    tagged = predictions.select(F.explode(F.array(F.lit("all"), outcome)).alias("subset"), number.alias("c"))
    basic = tagged.groupBy("subset").agg(
        F.count("c").alias("count"), F.avg("c").alias("mean"), F.min("c").alias("minimum"), F.max("c").alias("maximum")
    )
    quartiles = exact_quantiles(tagged, ["subset"], "c", [0.25, 0.5, 0.75], ["q25", "median", "q75"])
    grid = literals(predictions.sparkSession, ["all", "correct", "incorrect"], "subset")
    out = grid.join(basic, "subset", "left").join(quartiles, "subset", "left")
    return out.withColumn("count", _long(F.coalesce("count", F.lit(0))))


def uncertainty_by_class(
    predictions: DataFrame,
    threshold: float,
    classes: Sequence,
    *,
    truth: str = "truth",
    confidence: str = "confidence",
    correct: str = "correct",
) -> DataFrame:
    accepted = reaches(F.col(confidence), threshold)
    counted = predictions.groupBy(F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & F.col(correct)).alias("accepted_correct"),
    )
    filled = literals(predictions.sparkSession, classes, "label").join(counted, "label", "left").na.fill(0)
    return filled.select(
        "label",
        "rows",
        "accepted",
        (F.col("rows") - F.col("accepted")).alias("uncertain"),
        share(F.col("accepted"), F.col("rows")).alias("coverage"),
        "accepted_correct",
        share(F.col("accepted_correct"), F.col("accepted")).alias("accepted_accuracy"),
    )


def overall_result(
    predictions: DataFrame,
    threshold: float,
    *,
    entity: str = "entity",
    confidence: str = "confidence",
    correct: str = "correct",
    latency: str = "inference_ms",
) -> DataFrame:
    """One row of totals: sizes, accuracy, latency, coverage and both kinds of mistakes."""
    accepted = reaches(F.col(confidence), threshold)
    one = predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(entity).alias("entities"),
        F.count_if(F.col(correct)).alias("correct"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & F.col(correct)).alias("accepted_correct"),
        F.avg(latency).alias("mean_inference_ms"),
        F.sum(latency).alias("total_inference_ms"),
    )
    rows, good = F.col("rows"), F.col("correct")
    uncertain = rows - F.col("accepted")
    return one.select(
        "rows",
        "entities",
        "correct",
        (rows - good).alias("incorrect"),
        share(good, rows).alias("accuracy"),
        "accepted",
        uncertain.alias("uncertain"),
        share(F.col("accepted"), rows).alias("coverage"),
        share(uncertain, rows).alias("uncertain_rate"),
        share(F.col("accepted_correct"), F.col("accepted")).alias("accepted_accuracy"),
        (F.col("accepted") - F.col("accepted_correct")).alias("confident_mistakes"),
        (rows - good - (F.col("accepted") - F.col("accepted_correct"))).alias("low_confidence_mistakes"),
        "mean_inference_ms",
        "total_inference_ms",
    )


def mistakes(
    predictions: DataFrame, threshold: float, *, confidence: str = "confidence", correct: str = "correct"
) -> DataFrame:
    """Every wrong row tagged as confident or low-confidence mistake."""
    kind = F.when(reaches(F.col(confidence), threshold), "confident_mistake").otherwise("low_confidence_mistake")
    return predictions.filter(~F.col(correct)).withColumn("example_group", kind)


def representative_mistakes(
    predictions: DataFrame, threshold: float, key: str, n: int = 5, *, confidence: str = "confidence"
) -> DataFrame:
    """The n most confident confident mistakes and the n least confident of the others."""
    wrong = mistakes(predictions, threshold, confidence=confidence)
    severity = F.when(F.col("example_group") == "confident_mistake", -F.col(confidence)).otherwise(F.col(confidence))
    picked = top_rows(wrong.withColumn("__severity", severity), ["example_group"], ["__severity", key], n)
    return picked.drop("__severity")


def extreme_classes(report: DataFrame) -> DataFrame:
    """Strongest and weakest class by F1, the first label on ties."""
    return report.agg(
        F.min_by("label", F.struct(-F.col("f1"), F.col("label"))).alias("strongest"),
        F.max("f1").alias("strongest_f1"),
        F.min_by("label", F.struct(F.col("f1"), F.col("label"))).alias("weakest"),
        F.min("f1").alias("weakest_f1"),
    )


def best_run(runs: DataFrame, f1: str, accuracy: str, order: str) -> DataFrame:
    """Highest F1, then highest accuracy, then earliest run."""
    return runs.orderBy(F.desc(f1), F.desc(accuracy), F.asc(order)).limit(1)


def early_stop(
    history: DataFrame, run: str, epoch: str, metric: str, *, patience: int = 4, delta: float = 1e-4, max_epochs: int = 100_000
) -> DataFrame:
    """Replay early stopping per run: best epoch, epochs used, whether it stopped early.

    A run's epochs are put in one ordered array, so a run of more than
    ``max_epochs`` rows is an error, raised before any array is built.
    """
    longest = history.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    within = F.when(longest > max_epochs, F.raise_error(F.lit(f"a run has more than {max_epochs} epochs")).cast("boolean")).otherwise(True)
    point = F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(metric).cast("double").alias("score"))
    runs = history.filter(within).groupBy(run).agg(F.array_sort(F.collect_list(point)).alias("points"))
    start = F.struct(
        F.lit(float("-inf")).alias("best"),
        F.lit(0).cast("bigint").alias("best_epoch"),
        F.lit(0).cast("bigint").alias("stale"),
        F.lit(0).cast("bigint").alias("used"),
    )

    def step(state: Column, item: Column) -> Column:
        better = item["score"] > state["best"] + F.lit(delta)
        moved = F.struct(
            F.when(better, item["score"]).otherwise(state["best"]).alias("best"),
            F.when(better, item["epoch"]).otherwise(state["best_epoch"]).alias("best_epoch"),
            F.when(better, F.lit(0).cast("bigint")).otherwise(state["stale"] + 1).alias("stale"),
            (state["used"] + 1).alias("used"),
        )
        return F.when(state["stale"] >= patience, state).otherwise(moved)

    folded = runs.select(run, F.size("points").cast("bigint").alias("epochs"), F.aggregate("points", start, step).alias("s"))
    return folded.select(
        run,
        F.col("s.best").alias("best_metric"),
        F.col("s.best_epoch").alias("best_epoch"),
        F.col("s.used").alias("epochs_trained"),
        (F.col("s.stale") >= patience).alias("stopped_early"),
    )
