"""Freeze-then-evaluate protocol: choose on validation, record, verify, evaluate the held-out rows once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions.vectors import probability_problem
from labelproof.ml import bundles
from labelproof.operators import digests
from labelproof.operators import evaluation as ev
from labelproof.operators.gates import Check, count_rows, gate_rows, side_by_side
from labelproof.operators.joins import assignment_difference
from labelproof.operators.profile import leaked_entities
from labelproof.operators.splits import fingerprint
from labelproof.sources.sinks import write_csv, write_once

TOLERANCE = 1e-8

_number, _text, _flag, _whole = T.DoubleType(), T.StringType(), T.BooleanType(), T.LongType()
_fields = lambda *pairs: T.StructType([T.StructField(n, k) for n, k in pairs])
FREEZE_SCHEMA = _fields(
    ("status", _text),
    ("selected_model", _text),
    (
        "threshold",
        _fields(
            ("selected_threshold", _number),
            ("source_split", _text),
            ("test_data_used", _flag),
            ("validation_rows", _whole),
            ("accepted", _whole),
            ("coverage", _number),
            ("accepted_accuracy", _number),
        ),
    ),
    ("class_order", T.ArrayType(_text)),
    ("settings", T.MapType(_text, _number)),
    ("digests", T.MapType(_text, _text)),
    ("model_digest", _text),
    ("held_out", T.MapType(_text, _fields(("rows", _whole), ("entities", _whole)))),
    ("test_access", _fields(("rows_loaded", _whole), ("predictions_made", _whole), ("metrics_recorded", _flag))),
)


@dataclass(frozen=True)
class Paths:
    folder: str

    @property
    def freeze(self) -> str:
        return f"{self.folder}/freeze"

    def receipt(self, stage: str) -> str:
        return f"{self.folder}/receipt_{stage}"

    def record(self, table: str) -> str:
        return f"{self.folder}/record_{table}"

    def report(self, name: str) -> str:
        return f"{self.folder}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def table_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """Order-free fingerprint of each table, one row per name."""
    out = None
    for name, frame in tables.items():
        row = fingerprint(frame).select(F.lit(name).alias("name"), F.concat_ws(":", F.col("rows").cast("string"), "fingerprint").alias("digest"))
        out = row if out is None else out.unionByName(row)
    return out


def check_validation_rows(predictions: DataFrame, classes: Sequence[str], expected_rows: int | None = None) -> None:
    """Only validation rows, the expected number of them, and labels that match the probabilities."""
    problem = probability_problem(F.col("probabilities"), F.col("predicted"), classes, 1e-6)
    facts = predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("split") != "validation").alias("foreign"),
        F.count_if(problem != "").alias("bad"),
    ).first()
    if facts["foreign"]:
        raise AssertionError("threshold selection accepts validation rows only")
    if expected_rows is not None and facts["rows"] != expected_rows:
        raise AssertionError(f"expected {expected_rows} validation rows, found {facts['rows']}")
    if facts["bad"]:
        raise AssertionError(f"{facts['bad']} validation rows have invalid probabilities or labels")


def held_out_counts(items: DataFrame, *, entity: str, target: str, split: str) -> DataFrame:
    """One row: held-out rows and entities per class, as a map. Reads labels of no prediction."""
    held_out = items.filter(F.col(split) == "test")
    sizes = held_out.groupBy(F.col(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities")
    )
    entry = F.struct("label", F.struct("rows", "entities").alias("counts"))
    # one entry per class
    return sizes.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("held_out"))


def freeze_record(
    predictions: DataFrame,
    tables: dict[str, DataFrame],
    classes: Sequence[str],
    settings: dict[str, float],
    name: str,
    *,
    model_digest: str | None = None,
    counts: DataFrame | None = None,
    sweep: dict | None = None,
) -> DataFrame:
    """One nested row: chosen threshold, class order, settings, table digests, no test access yet.

    ``model_digest`` names the bundle that the evaluation has to load, ``counts`` is the row of
    :func:`held_out_counts`, and ``sweep`` changes the candidates and floors of the threshold.
    """
    check_validation_rows(predictions, classes)
    chosen = ev.choose_threshold(ev.threshold_sweep(predictions, **(sweep or {})))
    current = table_digests(tables).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "digest")))).alias("digests"))
    if counts is None:
        counts = predictions.sparkSession.range(1).select(F.lit(None).cast(FREEZE_SCHEMA["held_out"].dataType).alias("held_out"))
    facts = side_by_side([chosen, current, counts])
    numbers = [F.lit(x) for pair in settings.items() for x in (pair[0], float(pair[1]))]
    missing = F.raise_error(F.lit("no candidate threshold meets the accuracy and coverage floors"))
    return facts.select(
        F.lit("prepared").alias("status"),
        F.lit(name).alias("selected_model"),
        F.struct(
            F.coalesce("selected_threshold", missing.cast("double")).alias("selected_threshold"),
            F.lit("validation").alias("source_split"),
            F.lit(False).alias("test_data_used"),
            F.col("rows").alias("validation_rows"),
            F.col("accepted").alias("accepted"),
            F.col("coverage").alias("coverage"),
            F.col("accepted_accuracy").alias("accepted_accuracy"),
        ).alias("threshold"),
        F.array(*[F.lit(c) for c in classes]).alias("class_order"),
        F.create_map(*numbers).alias("settings"),
        "digests",
        F.lit(model_digest).cast("string").alias("model_digest"),
        "held_out",
        F.struct(F.lit(0).alias("rows_loaded"), F.lit(0).alias("predictions_made"), F.lit(False).alias("metrics_recorded")).alias(
            "test_access"
        ),
    )


def prepare(
    paths: Paths,
    predictions: DataFrame,
    tables: dict[str, DataFrame],
    classes,
    settings,
    name: str,
    *,
    keys: dict[str, Sequence[str]] | None = None,
    **recorded,
) -> DataFrame:
    """Write the freeze record; refuses when one, or a receipt, is already there.

    For each table that ``keys`` gives a key, the digests of its rows are kept, so that a change can be found by key.
    """
    spark = predictions.sparkSession
    for path in (paths.freeze, paths.receipt("started")):
        if exists(spark, path):
            raise FileExistsError(f"refusing to prepare again: {path} exists")
    record = freeze_record(predictions, tables, classes, settings, name, **recorded)
    for table, key in (keys or {}).items():
        digests.record(tables[table], key, paths.record(table))
    write_once(record.coalesce(1), paths.freeze)
    return spark.read.schema(record.schema).json(paths.freeze)


def contract_rows(freeze: DataFrame, tables: dict[str, DataFrame], classes: Sequence[str], settings: dict[str, float]) -> DataFrame:
    """Recorded against current: table digests, class order, settings, and how the threshold was chosen."""
    recorded = freeze.select(F.explode("digests").alias("name", "recorded"))
    compared = recorded.join(table_digests(tables), "name", "full_outer").select(
        F.concat(F.lit("digest "), F.col("name")).alias("check_name"),
        F.when(F.col("recorded").eqNullSafe(F.col("digest")), "PASS").otherwise("FAIL").alias("status"),
    )
    wanted = F.array(*[F.lit(c) for c in classes])
    current = F.create_map(*[F.lit(x) for pair in settings.items() for x in (pair[0], float(pair[1]))])
    off = F.map_filter(
        "settings", lambda k, v: F.coalesce(F.abs(v - F.try_element_at(current, k)) > TOLERANCE * (1 + F.abs(v)), F.lit(True))
    )
    checks = [
        Check("status prepared", F.col("status") == "prepared", F.col("status")),
        Check("class order", F.col("class_order") == wanted, F.array_join("class_order", ",")),
        Check("settings", (F.size(off) == 0) & (F.size("settings") == len(settings)), F.array_join(F.map_keys(off), ",")),
        Check("threshold from validation", F.col("threshold.source_split") == "validation", F.col("threshold.source_split")),
        Check("no test data in threshold", ~F.col("threshold.test_data_used"), F.col("threshold.test_data_used")),
    ]
    return gate_rows(freeze, checks).select("check_name", "status").unionByName(compared)


def changed_keys(paths: Paths, table: str, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, change): the keys of a recorded table that are not as they were when the contract was frozen."""
    return digests.changed_keys(current, key, paths.record(table))


def verify(freeze: DataFrame, tables: dict[str, DataFrame], classes, settings) -> float:
    """Raise on any broken part of the contract; returns the frozen threshold."""
    broken = [r[0] for r in contract_rows(freeze, tables, classes, settings).filter("status = 'FAIL'").collect()]
    if broken:
        raise AssertionError(f"frozen contract broken: {sorted(broken)}")
    return float(freeze.select("threshold.selected_threshold").first()[0])


def held_out_checks(items: DataFrame, assignments: DataFrame, *, entity: str, target: str, split: str) -> DataFrame:
    """No leaking entity in either table, and equal assignments."""
    facts = side_by_side(
        [
            count_rows(leaked_entities(items, entity, split), "leaked"),
            count_rows(leaked_entities(assignments, entity, split), "frozen_leaked"),
            count_rows(assignment_difference(items, assignments, [entity, target, split]), "differences"),
        ]
    )
    names = {"leaked": "item leakage", "frozen_leaked": "recorded leakage", "differences": "assignment match"}
    return gate_rows(facts, [Check(n, F.col(c) == 0, F.col(c)) for c, n in names.items()])


def check_counts(held_out: DataFrame, expected: dict[str, tuple[int, int]], *, entity: str, target: str) -> None:
    """Raise unless every class has the expected numbers of held-out rows and entities, and there is no other class."""
    sizes = held_out.groupBy(F.col(target).cast("string").alias(target)).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"))
    found = {r[target]: (r["rows"], r["entities"]) for r in sizes.limit(len(expected) + 1).collect()}
    if found != expected:
        wrong = {k: (expected.get(k), found.get(k)) for k in {*expected, *found} if expected.get(k) != found.get(k)}
        raise AssertionError(f"held-out rows and entities per class, expected and found: {wrong}")


def frozen_scorer(
    freeze: DataFrame, models: str | None, classes: Sequence[str], keys: Sequence[str], target: str, features: str, threshold: float
) -> Callable[[DataFrame], DataFrame]:
    """The scoring function of the bundle that the freeze record names."""
    digest = freeze.select("model_digest").first()[0]
    if digest is None or models is None:
        raise ValueError("without a scorer the freeze record must name a model and a folder must hold it")
    bundle = bundles.load(freeze.sparkSession, models, digest)
    if list(bundle.classes) != list(classes):
        raise AssertionError(f"the frozen model has other classes: {list(bundle.classes)}")
    return bundles.scorer(bundle, keys, target, features, threshold)


def evaluate_once(
    paths: Paths,
    items: DataFrame,
    assignments: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] | None,
    tables: dict[str, DataFrame],
    classes: Sequence[str],
    settings: dict[str, float],
    *,
    entity: str = "entity",
    target: str = "truth",
    split: str = "split",
    key: str = "item_id",
    expected: dict[str, tuple[int, int]] | None = None,
    models: str | None = None,
    features: str = "features",
) -> DataFrame:
    """Verify the contract, score the held-out rows once, write every report and the receipt.

    ``expected`` holds the numbers of held-out rows and entities of each class;
    without it those that the freeze record holds, if any, are required. Without
    a ``scorer`` the bundle that the record names by its digest is read from
    ``models`` and scores the column ``features``. Cheap checks come before scoring, and a started receipt is written before
    the first held-out row is scored, so a second run is refused.
    """
    spark = items.sparkSession
    if exists(spark, paths.receipt("started")):
        raise RuntimeError("held-out evaluation has already started; refusing to run it again")
    freeze = spark.read.json(paths.freeze, schema=FREEZE_SCHEMA)
    threshold = verify(freeze, tables, classes, settings)
    failed = held_out_checks(items, assignments, entity=entity, target=target, split=split).filter("status = 'FAIL'").collect()
    if failed:
        raise AssertionError(f"held-out checks failed: {[r['check_name'] for r in failed]}")
    if expected is None:
        recorded = freeze.select("held_out").first()[0]
        expected = None if recorded is None else {k: (v["rows"], v["entities"]) for k, v in recorded.items()}
    if expected is not None:
        check_counts(items.filter(F.col(split) == "test"), expected, entity=entity, target=target)
    if scorer is None:
        scorer = frozen_scorer(freeze, models, classes, [key, entity, split], target, features, threshold)
    started = spark.range(1).select(F.lit("started").alias("status"), F.lit(False).alias("rerun_allowed"), F.current_timestamp().alias("at"))
    write_once(started, paths.receipt("started"))

    path = paths.report("predictions")
    scorer(items.filter(F.col(split) == "test")).write.mode("errorifexists").parquet(path)
    scored = spark.read.parquet(path)
    reports = {
        "classification_report": ev.class_report(scored, classes),
        "confusion_matrix": ev.confusion_wide(scored, classes),
        "confidence_distribution": ev.confidence_histogram(scored),
        "uncertainty_by_class": ev.uncertainty_by_class(scored, threshold, classes),
        "error_directions": ev.error_directions(scored),
        "mistakes": ev.mistakes(scored, threshold).drop("probabilities"),
        "representative_mistakes": ev.representative_mistakes(scored, threshold, key).drop("probabilities"),
    }
    overall = ev.overall_result(scored, threshold, entity=entity)
    macro = ev.headline(scored, classes).select("macro_f1")
    metrics = side_by_side([overall, macro]).withColumn("threshold", F.lit(threshold))
    # independent small jobs over one stored table: submit them together
    with ThreadPoolExecutor(len(reports) + 2) as pool:
        # the inputs must not have changed while scoring
        checked = pool.submit(verify, freeze, tables, classes, settings)
        written = [pool.submit(write_csv, frame, paths.report(name)) for name, frame in reports.items()]
        written.append(pool.submit(write_once, metrics.coalesce(1), paths.report("metrics")))
    for job in (checked, *written):
        job.result()
    done = spark.read.schema(metrics.schema).json(paths.report("metrics"))
    receipt = done.select(F.lit("completed").alias("status"), F.lit(False).alias("rerun_allowed"), "rows", F.current_timestamp().alias("at"))
    write_once(receipt, paths.receipt("completed"))
    return done
