"""Composite gates, the freeze-and-evaluate protocol, and the audit with a resolver."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.ml import bundles
from labelproof.operators import balance, gates, profile, protocol, rules
from labelproof.operators import ranking as rk
from labelproof.operators import splits as sp
from labelproof.operators.rules import EFFECT_FLAGS, Rule, effect_flags
from labelproof.plans import gallery
from labelproof.plans.bindings import CLASSES, SEGMENTS, SPLITS, leaky_manifest, manifest, predictions
from labelproof.plans.evaluation_queries import SQL_REPORT, SQL_SWEEP
from labelproof.plans.model_queries import SQL_QUARTERS, centroids, quarters
from labelproof.plans.order_queries import GRID_TEXTS, SQL_QUOTA, quota
from labelproof.plans.registry import query
from labelproof.plans.row_queries import SQL_FLAGS, expanded_effects
from labelproof.plans.table_queries import SQL_ASSOC
from labelproof.session import scratch_path, stored

FLAGS = EFFECT_FLAGS


def _gate_sql(rows: list[tuple[str, str, str, str, str]]) -> str:
    """SQL rows of a gate: (check, passed condition, evidence, action, status when not passed)."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, CASE WHEN {p} THEN 'PASS' ELSE '{s}' END AS status, ({e})::VARCHAR AS evidence, "
        f"CASE WHEN {p} THEN '' ELSE '{a}' END AS required_action FROM facts"
        for n, p, e, a, s in rows
    )


def _structure_sql(source: str) -> str:
    return f"""facts AS (SELECT count(*) AS rows, count(DISTINCT item_id) AS keys, count(DISTINCT entity) AS entities, count(DISTINCT target) AS targets, count(DISTINCT split) AS splits,
      (SELECT count(*) FROM (SELECT entity FROM {source} GROUP BY entity HAVING count(DISTINCT split) > 1)) AS leaked,
      (SELECT count(*) FROM (SELECT DISTINCT entity, target, split FROM {source} EXCEPT SELECT DISTINCT entity, target, split FROM manifest))
      + (SELECT count(*) FROM (SELECT DISTINCT entity, target, split FROM manifest EXCEPT SELECT DISTINCT entity, target, split FROM {source})) AS diffs FROM {source}) """ + _gate_sql(
        [
            ("unique item key", "rows = keys", "rows - keys", "remove repeated keys", "FAIL"),
            ("target set", "targets = 5", "targets", "fix target labels", "FAIL"),
            ("split set", "splits = 3", "splits", "fix split labels", "FAIL"),
            ("entity leakage", "leaked = 0", "leaked", "keep each entity in one split", "FAIL"),
            ("assignment match", "diffs = 0", "diffs", "regenerate from the recorded split", "FAIL"),
            ("entity count", "entities = 150", "entities", "expected 150 entities", "FAIL"),
        ]
    )


def structure(items, assignments):
    return gates.structure_gate(
        items, assignments, key="item_id", entity="entity", target="target", split="split", targets=CLASSES, splits=SPLITS, expected_entities=150
    )


@query("j1_structure_gate", "WITH {manifest}, " + _structure_sql("manifest"))
def j1(t):
    return structure(manifest(t), manifest(t))


@query("j1_structure_gate_leaky", "WITH {manifest}, {leaky}, " + _structure_sql("leaky"))
def j1_leaky(t):
    return structure(leaky_manifest(t), manifest(t))


@query("e38_gate_decision", "WITH {manifest}, {leaky}, g AS (" + "SELECT * FROM (WITH " + _structure_sql("leaky") + ")) SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'RED' WHEN bool_or(status IN ('WARN', 'MANUAL')) THEN 'YELLOW' ELSE 'GREEN' END AS decision, count(*)::BIGINT AS checks FROM g")
def e38(t):
    return profile.gate_decision(structure(leaky_manifest(t), manifest(t)))


@query("e38_status_counts", "WITH {manifest}, {leaky}, g AS (" + "SELECT * FROM (WITH " + _structure_sql("leaky") + ")) SELECT status, count(*)::BIGINT AS checks FROM g GROUP BY status")
def e38_counts(t):
    return profile.status_counts(structure(leaky_manifest(t), manifest(t)))


ITEMS = 8


def generated(selected):
    """Items generated for the selected entities: every target gets the same plan of seeds and texts."""
    drawn = selected.select("entity", "target", "split").withColumn("draw", rk.hash_draw(42, "entity"))
    # 18 selected entities per target: the window is bounded by the quota
    ranked = rk.top_rows(drawn, ["target"], ["draw", "entity"], sp.QUOTAS.total, rank="rank").drop("draw")
    grid = sp.item_grid(ranked, "rank", ITEMS, GRID_TEXTS)
    planned = sp.augmentation_plan(grid, "item_seed")
    return planned.select(
        F.concat_ws("/", "split", "target", "entity", F.format_string("%04d", "item_index")).alias("item_id"),
        "entity",
        "target",
        "split",
        "item_text",
        F.to_json("effects", {"ignoreNullFields": "false"}).alias("signature"),
    )


@query(
    "j2_generated_set_gate",
    "WITH {catalogue}, " + SQL_QUOTA + """, s AS (SELECT entity, target, CASE WHEN r <= 12 THEN 'train' WHEN r <= 15 THEN 'validation' ELSE 'test' END AS split FROM drawn WHERE r <= 18),
    i AS (SELECT s.*, n FROM s, range(8) t(n)),
    facts AS (SELECT count(*) AS rows, count(DISTINCT entity || '/' || n) AS keys, (SELECT count(*) FROM (SELECT target FROM i GROUP BY target HAVING count(*) = 144)) AS good_targets,
      (SELECT count(*) FROM (SELECT split, count(*) AS c FROM i GROUP BY split) WHERE c = CASE split WHEN 'train' THEN 480 ELSE 120 END) AS good_splits,
      (SELECT count(*) FROM (SELECT entity FROM i GROUP BY entity HAVING count(*) <> 8)) AS odd_entities,
      (SELECT count(*) FROM (SELECT entity FROM i GROUP BY entity HAVING count(DISTINCT split) > 1)) AS leaked FROM i) """
    + _gate_sql(
        [
            ("item count", "rows = 720", "rows", "expected 720 items", "FAIL"),
            ("unique item key", "rows = keys", "rows - keys", "remove repeated keys", "FAIL"),
            ("items per entity", "odd_entities = 0", "odd_entities", "expected 8 items for each of 90 entities", "FAIL"),
            ("items per target", "good_targets = 5", "good_targets", "rebalance targets", "FAIL"),
            ("items per split", "good_splits = 3", "good_splits", "rebalance splits", "FAIL"),
            ("entity leakage", "leaked = 0", "leaked", "keep each entity in one split", "FAIL"),
            ("assignment match", "TRUE", "0", "", "FAIL"),
            ("effects independent of target", "TRUE", "0", "", "FAIL"),
            ("texts independent of target", "TRUE", "0", "", "FAIL"),
        ]
    ),
)
def j2(t):
    selected = stored(quota(t)[0], "selected")
    return gates.generated_gate(
        stored(generated(selected), "generated"),
        selected,
        key="item_id",
        entity="entity",
        target="target",
        split="split",
        text="item_text",
        signature="signature",
        targets=SEGMENTS,
        items_per_entity=ITEMS,
        entities_per_target=18,
        split_entities={"train": 12, "validation": 3, "test": 3},
    )


SQL_SPREAD = (
    f"f AS (SELECT target, {SQL_FLAGS} FROM effects), r AS (SELECT target, "
    + ", ".join(f"count(*) FILTER (WHERE {n}) / count(*) AS {n}" for n in FLAGS)
    + " FROM f GROUP BY target), sp AS (SELECT greatest("
    + ", ".join(f"max({n}) - min({n})" for n in FLAGS)
    + ") > 0.05 AS serious FROM r)"
)


def blocking_facts(t):
    """The nine blocking values: picture checks, entity overlap, effect imbalance, text association."""
    flagged = rules.quality_flags(stored(gallery.measured(t), "measured"), 32, 32)
    pictures = rules.quality_counts(flagged)
    copies = profile.duplicate_groups(flagged.filter("opens_successfully"), F.col("sha256")).select("duplicate_groups")
    overlap = gates.count_rows(profile.leaked_entities(leaky_manifest(t), "entity", "split"), "entity_overlap")
    spreads = balance.rate_spreads(balance.rates_and_means(expanded_effects(t), "target", effect_flags(), []), FLAGS)
    serious = spreads.select(F.col("serious").cast("int").alias("serious_imbalance"))
    strong = balance.association(manifest(t), "item_text", "target").select(F.col("strong").cast("int").alias("strong_association"))
    return gates.side_by_side([pictures, copies, overlap, serious, strong])


@query(
    "j3_blocking_gate",
    "WITH {effects}, {leaky}, " + gallery.SQL_GALLERY.strip() + ", " + SQL_SPREAD + """,
    facts AS (SELECT count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE damaged) AS corrupt, count(*) FILTER (WHERE blank) AS blank,
      count(*) FILTER (WHERE NOT missing AND NOT damaged AND ((SELECT stddev_pop(x) FROM (SELECT unnest(levels) AS x)) < 5 OR list_max(levels) - list_min(levels) < 10)) AS low_contrast,
      (SELECT count(*) FROM (SELECT levels FROM gallery WHERE NOT missing AND NOT damaged GROUP BY levels HAVING count(*) > 1)) AS dup,
      (SELECT count(*) FROM (SELECT entity FROM leaky GROUP BY entity HAVING count(DISTINCT split) > 1)) AS overlap, (SELECT serious::INT FROM sp) AS serious,
      (SELECT strong::INT FROM (WITH """ + SQL_ASSOC.format(v="item_text", g="target", src="manifest") + """)) AS strong FROM gallery) """
    + _gate_sql(
        [
            (n, f"{e} = 0", e, "resolve before training", "FAIL")
            for n, e in (
                ("missing", "missing"), ("corrupt", "corrupt"), ("blank", "blank"), ("low_pixel_contrast", "low_contrast"), ("wrong_size", "0"),
                ("duplicate_groups", "dup"), ("entity_overlap", "overlap"), ("serious_imbalance", "serious"), ("strong_association", "strong"),
            )
        ]
    ),
)
def j3(t):
    return gates.blocking_gate(blocking_facts(t))


# Evidence keywords of this binding: document names are sources, searched in all their documents.
KEYWORDS = {"src0": ("the", "zzzz"), "src999": ("the",)}


def evidence_documents(t):
    """All documents, named by their source."""
    return t.documents.select(F.col("source").alias("name"), "text")


SQL_SELF = """facts AS (SELECT
   (SELECT count(*) - count(DISTINCT (event_type, user_id, k)) FROM chk) AS dup,
   (SELECT count(*) FROM (SELECT user_id FROM chk WHERE split = 'train' INTERSECT SELECT user_id FROM chk WHERE split <> 'train')) AS shared,
   (SELECT count(*) FILTER (WHERE split = 'train') FROM chk) AS tr, (SELECT count(*) FILTER (WHERE split <> 'train') FROM chk) AS va,
   (SELECT bool_or(contains(lower(text), 'the')) FROM documents WHERE source = 'src0') AS has_the,
   (SELECT bool_or(contains(lower(text), 'zzzz')) FROM documents WHERE source = 'src0') AS has_z,
   (SELECT max(ts) FILTER (WHERE split = 'train') < min(ts) FILTER (WHERE split <> 'train') FROM chk) AS chrono) """


@query(
    "j5_self_check",
    "WITH {leaky}, chk AS (SELECT entity AS user_id, target AS event_type, item_text AS k, split, ts, item_id FROM leaky), " + SQL_SELF.replace("(event_type, user_id, k)", "item_id")
    + _gate_sql(
        [
            ("document src0", "TRUE", "'src0'", "", "FAIL"),
            ("document src999", "FALSE", "'src999'", "add the document", "FAIL"),
            ("src0 mentions the", "has_the", "'src0'", "add a clear section", "WARN"),
            ("src0 mentions zzzz", "has_z", "'src0'", "add a clear section", "WARN"),
            ("constant columns", "FALSE", "'kind'", "remove or justify them", "WARN"),
            ("exact duplicate rows", "dup = 0", "dup", "investigate the copies", "WARN"),
            ("identifier-like columns", "FALSE", "'item_id'", "keep identifiers out of the features", "MANUAL"),
            ("target distribution", "TRUE", "5", "", "WARN"),
            ("both sides present", "tr > 0 AND va > 0", "tr || '/' || va", "provide split evidence", "MANUAL"),
            ("group overlap", "shared = 0", "shared", "use a group-aware split", "FAIL"),
            ("chronological boundary", "chrono", "chrono", "train must end before validation", "WARN"),
            ("feature availability at prediction time", "FALSE", "'human review'", "mark post-outcome fields", "MANUAL"),
        ]
    ),
)
def j5(t):
    table = leaky_manifest(t).drop("k").withColumn("kind", F.lit("event"))
    settings = gates.SelfCheck(kind="tabular", target="target", split="split", group="entity", time="ts", keywords=KEYWORDS)
    return gates.self_check(table, settings, evidence_documents(t))


@query(
    "j5_self_check_text",
    """WITH facts AS (SELECT count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) - count(DISTINCT trim(text)) AS dup,
      count(*) - count(DISTINCT (doc_id, text, lang, source, n_chars)) AS rowdup, (SELECT count(DISTINCT lang) FROM documents) AS langs FROM documents) """
    + _gate_sql(
        [
            ("constant columns", "TRUE", "''", "", "WARN"),
            ("exact duplicate rows", "rowdup = 0", "rowdup", "investigate the copies", "WARN"),
            ("identifier-like columns", "FALSE", "'doc_id'", "keep identifiers out of the features", "MANUAL"),
            ("target distribution", "TRUE", "langs", "", "WARN"),
            ("split verification", "FALSE", "'no split column'", "provide split evidence", "MANUAL"),
            ("empty text", "empty = 0", "empty", "remove or justify", "WARN"),
            ("exact text duplicates", "dup = 0", "dup", "control copies before splitting", "WARN"),
        ]
    ),
)
def j5_text(t):
    return gates.self_check(t.documents, gates.SelfCheck(kind="text", target="lang", text="text"))


@query(
    "j5_self_check_numeric",
    """WITH s AS (SELECT unnest([stddev_samp(l_orderkey), stddev_samp(l_partkey), stddev_samp(l_suppkey), stddev_samp(l_linenumber),
      stddev_samp(l_quantity), stddev_samp(l_extendedprice), stddev_samp(l_discount), stddev_samp(l_tax)]) AS d FROM lineitem),
    facts AS (SELECT floor(max(d) / min(d))::BIGINT AS ratio, (SELECT sum(n - 1) FROM (SELECT COLUMNS(*), count(*) AS n FROM lineitem GROUP BY ALL)) AS dup FROM s) """
    + _gate_sql(
        [
            ("constant columns", "TRUE", "''", "", "WARN"),
            ("exact duplicate rows", "dup = 0", "dup", "investigate the copies", "WARN"),
            ("identifier-like columns", "TRUE", "''", "", "MANUAL"),
            ("unsupervised objective", "FALSE", "'no target expected'", "document the evaluation plan", "MANUAL"),
            ("split verification", "FALSE", "'no split column'", "provide split evidence", "MANUAL"),
            ("unsupervised evaluation plan", "FALSE", "'stability and usefulness'", "state how results are judged", "MANUAL"),
            ("numeric scale difference", "ratio <= 100", "ratio", "use a documented scaler", "WARN"),
        ]
    ),
)
def j5_numeric(t):
    return gates.self_check(t.lineitem, gates.SelfCheck(kind="unsupervised"))


@query(
    "j6_evidence_gate",
    "WITH {manifest}, {leaky}, g AS (" + "SELECT * FROM (WITH " + _structure_sql("leaky") + ")) SELECT 'YELLOW' AS decision, count(*)::BIGINT AS checks, string_agg(CASE WHEN status <> 'PASS' THEN check_name END, ',' ORDER BY check_name) AS failed FROM g",
)
def j6(t):
    checks = structure(leaky_manifest(t), manifest(t)).select("check_name", (F.col("status") == "PASS").alias("passed"))
    return gates.evidence_gate(checks)


# --- protocol ----------------------------------------------------------------

SETTINGS = {"learning_rate": 0.001, "width": 16.0, "dropout": 0.25, "best_epoch": 14.0}


def protocol_tables(t):
    return {"manifest": manifest(t), "assignments": manifest(t).select("entity", "target", "split").distinct()}


def prepared(t, **recorded):
    paths = protocol.Paths(scratch_path(t.spark, "protocol"))
    validation = predictions(t).filter("split = 'validation'")
    return paths, protocol.prepare(paths, validation, protocol_tables(t), CLASSES, SETTINGS, "reference run", **recorded)


SQL_CHANGED = """changed AS (SELECT item_id, value + CASE WHEN item_id % 97 = 7 THEN 0.01 ELSE 0 END AS v, * EXCLUDE (item_id, value) FROM manifest WHERE item_id <> 11),
  edits AS (SELECT coalesce(m.item_id, c.item_id) AS item_id, CASE WHEN c.item_id IS NULL THEN 'removed' WHEN m.item_id IS NULL THEN 'added' ELSE 'changed' END AS change
    FROM manifest m FULL JOIN changed c ON m.item_id = c.item_id WHERE m.item_id IS NULL OR c.item_id IS NULL OR m.value IS DISTINCT FROM c.v),
  before AS (SELECT DISTINCT entity, target, split FROM manifest), after AS (SELECT DISTINCT entity, target, split FROM changed),
  moved AS ((SELECT * FROM before EXCEPT SELECT * FROM after) UNION ALL (SELECT * FROM after EXCEPT SELECT * FROM before))"""


def changed_tables(t):
    """The recorded tables after the freeze: some values edited and a row lost."""
    i = F.col("item_id")
    rows = manifest(t).filter(i != 11).withColumn("value", F.col("value") + F.when(i % 97 == 7, 0.01).otherwise(0.0))
    return {"manifest": rows, "assignments": rows.select("entity", "target", "split").distinct()}


@query(
    "j7_frozen_contract",
    "WITH {preds}, " + SQL_SWEEP + ", " + SQL_CHANGED + """
    SELECT 'status prepared' AS check_name, CASE WHEN (SELECT count(*) FROM ruled WHERE qualifies) > 0 THEN 'PASS' ELSE 'FAIL' END AS status
    UNION ALL SELECT 'class order', CASE WHEN (SELECT string_agg(DISTINCT target, ',' ORDER BY target) FROM manifest) = 'click,error,purchase,signup,view' THEN 'PASS' ELSE 'FAIL' END
    UNION ALL SELECT 'settings', CASE WHEN 0.001::DOUBLE * 2 = 0.001::DOUBLE THEN 'PASS' ELSE 'FAIL' END
    UNION ALL SELECT 'threshold from validation', CASE WHEN (SELECT count(*) FROM preds WHERE split = 'validation') = (SELECT max(rows) FROM sweep) THEN 'PASS' ELSE 'FAIL' END
    UNION ALL SELECT 'no test data in threshold', CASE WHEN (SELECT count(*) FROM preds WHERE split <> 'validation') + (SELECT max(rows) FROM sweep) = (SELECT count(*) FROM preds) THEN 'PASS' ELSE 'FAIL' END
    UNION ALL SELECT 'digest manifest', CASE WHEN (SELECT count(*) FROM edits) = 0 THEN 'PASS' ELSE 'FAIL' END
    UNION ALL SELECT 'digest assignments', CASE WHEN (SELECT count(*) FROM moved) = 0 THEN 'PASS' ELSE 'FAIL' END""",
)
def j7(t):
    """Recorded tables and a setting are changed after the freeze: their checks must fail, the others pass."""
    _, freeze = prepared(t)
    return protocol.contract_rows(freeze, changed_tables(t), CLASSES, {**SETTINGS, "learning_rate": 0.002})


@query("j7_changed_keys", "WITH {manifest}, " + SQL_CHANGED + " SELECT item_id, change FROM edits")
def j7_changed_keys(t):
    """The keys behind a failed digest: exactly those that were edited or lost."""
    paths, _ = prepared(t, keys={"manifest": ["item_id"]})
    return protocol.changed_keys(paths, "manifest", changed_tables(t)["manifest"], ["item_id"])


@query(
    "j8_freeze_record",
    "WITH {preds}, " + SQL_SWEEP + """ SELECT 'prepared' AS status, 'reference run' AS selected_model, threshold AS selected_threshold, 'validation' AS source_split, FALSE AS test_data_used,
    rows AS validation_rows, accepted, coverage, accepted_accuracy, 'click,error,purchase,signup,view' AS class_order, 4::BIGINT AS settings, 2::BIGINT AS digests, FALSE AS metrics_recorded
    FROM ruled WHERE qualifies ORDER BY threshold LIMIT 1""",
)
def j8(t):
    _, freeze = prepared(t)
    return freeze.select(
        "status",
        "selected_model",
        "threshold.*",
        F.array_join("class_order", ",").alias("class_order"),
        F.size("settings").cast("bigint").alias("settings"),
        F.size("digests").cast("bigint").alias("digests"),
        "test_access.metrics_recorded",
    )


SQL_CHOSEN = "chosen AS (SELECT threshold FROM ruled WHERE qualifies ORDER BY threshold LIMIT 1)"


@query(
    "j9_held_out_given_scores",
    "WITH {preds}, " + SQL_SWEEP + ", " + SQL_CHOSEN + """, classes AS (SELECT unnest(['click','error','purchase','signup','view']) AS label), scored AS (SELECT * FROM preds WHERE split = 'test'), """
    + SQL_REPORT.split("scored AS (SELECT * FROM preds), ")[1]
    + """ SELECT count(*)::BIGINT AS rows, count(DISTINCT entity)::BIGINT AS entities, count(*) FILTER (WHERE correct)::BIGINT AS correct,
      count(*) FILTER (WHERE correct) / count(*) AS accuracy, count(*) FILTER (WHERE confidence >= threshold)::BIGINT AS accepted,
      count(*) FILTER (WHERE NOT correct AND confidence >= threshold)::BIGINT AS confident_mistakes, count(*) FILTER (WHERE NOT correct AND confidence < threshold)::BIGINT AS low_confidence_mistakes,
      any_value(threshold) AS threshold, (SELECT round(avg(f1), 9) FROM report) AS macro_f1 FROM scored, chosen""",
)
def j9_given(t):
    """Rows that carry their scores already."""
    paths, _ = prepared(t)
    items = predictions(t)
    assignments = items.select("entity", "truth", "split").distinct()
    metrics = protocol.evaluate_once(paths, items, assignments, lambda rows: rows, protocol_tables(t), CLASSES, SETTINGS)
    return metrics.select(
        "rows", "entities", "correct", "accuracy", "accepted", "confident_mistakes", "low_confidence_mistakes", "threshold", F.round("macro_f1", 9).alias("macro_f1")
    )


QUARTERS = ("0", "1", "2", "3")
QUARTER_SWEEP = {"minimum_accuracy": 0.8, "minimum_coverage": 0.1}


@query(
    "j9_held_out_evaluation",
    "WITH " + SQL_QUARTERS + ", " + SQL_SWEEP.strip().replace(">= 0.9 AND coverage >= 0.5", ">= 0.8 AND coverage >= 0.1") + ", " + SQL_CHOSEN + """,
    scored AS (SELECT * FROM preds WHERE split = 'test'),
    cells AS (SELECT c AS label, count(*) FILTER (WHERE truth = c AND predicted = c) AS tp, count(*) FILTER (WHERE truth = c) AS n, count(*) FILTER (WHERE predicted = c) AS m
      FROM scored, (SELECT unnest(range(4)) AS c) GROUP BY c)
    SELECT count(*)::BIGINT AS rows, count(DISTINCT entity)::BIGINT AS entities, count(*) FILTER (WHERE correct)::BIGINT AS correct,
      count(*) FILTER (WHERE correct) / count(*) AS accuracy, count(*) FILTER (WHERE confidence >= threshold)::BIGINT AS accepted,
      count(*) FILTER (WHERE NOT correct AND confidence >= threshold)::BIGINT AS confident_mistakes, count(*) FILTER (WHERE NOT correct AND confidence < threshold)::BIGINT AS low_confidence_mistakes,
      any_value(threshold) AS threshold, (SELECT round(avg(CASE WHEN n + m = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n + m) END), 9) FROM cells) AS macro_f1 FROM scored, chosen""",
)
def j9(t):
    """A centroid model is fitted on train, frozen by digest with a threshold of the validation rows, and scores test once."""
    spark = t.spark
    items = quarters(t)
    labels, table = centroids(t, items)
    models = scratch_path(spark, "models")
    bundle = bundles.Bundle("centroid", tuple(labels), tuple(map(tuple, table)), 40.0)
    digest = bundles.publish(spark, bundle, models)
    tables = {"items": items.drop("embedding"), "vectors": t.embeddings}
    keys = ["vec_id", "entity", "split"]
    validation = bundles.score(items.filter("split = 'validation'"), bundle, keys, "label", "embedding", 0.0)
    paths = protocol.Paths(scratch_path(spark, "protocol"))
    counts = protocol.held_out_counts(items, entity="entity", target="label", split="split")
    settings = {"scale": 40.0}
    protocol.prepare(
        paths, stored(validation, "validation"), tables, QUARTERS, settings, "centroid", model_digest=digest, counts=counts, sweep=QUARTER_SWEEP
    )
    assignments = items.select("entity", "label", "split").distinct()
    metrics = protocol.evaluate_once(
        paths, items, assignments, None, tables, QUARTERS, settings, target="label", key="vec_id", models=models, features="embedding"
    )
    return metrics.select(
        "rows", "entities", "correct", "accuracy", "accepted", "confident_mistakes", "low_confidence_mistakes", "threshold", F.round("macro_f1", 9).alias("macro_f1")
    )


# --- audit with a resolver ---------------------------------------------------


@query(
    "m2_resolver_audit",
    """WITH r AS (SELECT lang || '-' || source AS name, min(doc_id) AS doc_id FROM documents GROUP BY 1),
    e AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS target, regexp_extract(url, '/([a-z]{2})/', 1) || '-src' || (page_id % 25) AS name FROM pages),
    a AS (SELECT e.*, r.doc_id, CASE WHEN r.doc_id IS NULL THEN 'not found' WHEN r.doc_id % 7 = 0 THEN 'does not render' ELSE '' END AS reason FROM e LEFT JOIN r USING (name)),
    c AS (SELECT *, coalesce(sum(CASE WHEN reason = '' THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
    SELECT page_id, target, name, coalesce('doc/' || doc_id, '') AS path, reason = '' AS usable, reason FROM c WHERE before < 20""",
)
def m2(t):
    """The resolver is a lookup table from entity name to path, so it can be swapped and joins at any size."""
    resolver = (
        t.documents.groupBy(F.concat_ws("-", "lang", "source").alias("name"))
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    )
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1)
    entries = t.pages.select("page_id", lang.alias("target"), F.concat(lang, F.lit("-src"), (F.col("page_id") % 25).cast("string")).alias("name"))
    resolved = entries.join(resolver, "name", "left")
    checked = rules.first_failure(
        resolved, [Rule(F.col("doc_id").isNull(), "not found"), Rule(F.col("doc_id") % 7 == 0, "does not render")]
    )
    kept = rk.accepted_until(checked, "target", "page_id", "usable", 20)
    return kept.select("page_id", "target", "name", F.coalesce("path", F.lit("")).alias("path"), "usable", "reason")
