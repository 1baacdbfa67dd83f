"""Join, aggregate, balance and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.functions import text as tx
from labelproof.operators import balance, joins, profile
from labelproof.operators import reshape
from labelproof.operators.ranking import SLICE, draw_slice, hash_draw, numbered
from labelproof.operators.rules import EFFECT_FLAGS, effect_flags
from labelproof.plans.bindings import CLASSES, LANGUAGES, SEGMENTS, catalogue, docs, effects, leaky_manifest, manifest, predictions, split_label
from labelproof.plans.registry import query
from labelproof.plans.row_queries import SQL_FLAGS, expanded_effects
from labelproof.schemas import EFFECTS

FLAGS = EFFECT_FLAGS

# --- scans through SQL -------------------------------------------------------


@query(
    "a9_sql_on_views",
    """WITH {manifest} SELECT target, split, count(*)::BIGINT AS items, count(DISTINCT entity)::BIGINT AS entities
    FROM manifest WHERE split = 'train' GROUP BY target, split""",
)
def a9(t):
    manifest(t).createOrReplaceTempView("labelproof_manifest")
    return t.spark.sql(
        "SELECT target, split, count(*) AS items, count(DISTINCT entity) AS entities "
        "FROM labelproof_manifest WHERE split = :split GROUP BY target, split",
        args={"split": "train"},
    )


# --- joins -------------------------------------------------------------------


@query(
    "d1_rates_join_means",
    f"""WITH {{effects}}, r AS (SELECT target, count(*) FILTER (WHERE blur_radius IS NOT NULL) / count(*) AS blur_rate FROM effects GROUP BY target),
    m AS (SELECT target, round(avg(actual_font_size), 6) AS mean_size FROM effects GROUP BY target)
    SELECT r.target, blur_rate, mean_size FROM r LEFT JOIN m USING (target)""",
)
def d1(t):
    e = expanded_effects(t)
    table = balance.rates_and_means(e, "target", {"blur_rate": F.col("blur_radius").isNotNull()}, ["actual_font_size"])
    return table.select("target", "blur_rate", F.round("mean_actual_font_size", 6).alias("mean_size"))


@query(
    "d2_side_by_side",
    """WITH {effects} SELECT l.item_id, l.target, r.background, r.jpeg_quality FROM manifest l JOIN effects r USING (item_id)""",
)
def d2(t):
    side = expanded_effects(t).select("item_id", "background", "jpeg_quality")
    return manifest(t).select("item_id", "target").join(side, "item_id")


SQL_OTHER_SPLIT = """CASE WHEN entity % 10 = 0 THEN (CASE WHEN ('0x' || substr(sha256('44|' || entity::VARCHAR), 1, 8))::BIGINT % 100 < 70 THEN 'train'
 WHEN ('0x' || substr(sha256('44|' || entity::VARCHAR), 1, 8))::BIGINT % 100 < 85 THEN 'validation' ELSE 'test' END) ELSE split END"""


@query(
    "d3_assignment_difference",
    f"""WITH {{manifest}}, a AS (SELECT DISTINCT entity, target, split FROM manifest),
    b AS (SELECT DISTINCT entity, target, {SQL_OTHER_SPLIT} AS split FROM manifest)
    (SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
    UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))""",
)
def d3(t):
    m = manifest(t)
    other = m.withColumn("split", F.when(F.col("entity") % 10 == 0, split_label(44, "entity")).otherwise(F.col("split")))
    return joins.assignment_difference(m, other, ["entity", "target", "split"])


@query(
    "d4_missing_references",
    "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)",
)
def d4(t):
    return joins.missing_references(t.documents.select("doc_id"), t.labels, "doc_id")


@query(
    "d4_missing_summary",
    "SELECT count(*)::BIGINT AS missing, min(doc_id) AS first_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def d4_summary(t):
    return joins.missing_summary(t.documents.select("doc_id"), t.labels, "doc_id")


@query(
    "d5_listing_difference",
    """WITH disk AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), listed AS (SELECT s_suppkey + 3 AS k FROM supplier)
    (SELECT k, 'on_disk' AS only_in FROM (SELECT k FROM disk EXCEPT SELECT k FROM listed))
    UNION ALL (SELECT k, 'listed' FROM (SELECT k FROM listed EXCEPT SELECT k FROM disk))""",
)
def d5(t):
    disk = t.lineitem.select(F.col("l_suppkey").alias("k"))
    return joins.listing_difference(disk, t.supplier.select((F.col("s_suppkey") + 3).alias("k")), "k")


@query(
    "d7_group_overlap",
    """WITH {leaky} SELECT DISTINCT entity FROM leaky WHERE split = 'train' AND entity IS NOT NULL
    INTERSECT SELECT entity FROM leaky WHERE split = 'validation'""",
)
def d7(t):
    m = leaky_manifest(t)
    return joins.shared_groups(m.filter("split = 'train'"), m.filter("split = 'validation'"), "entity")


@query(
    "d8_run_equivalence",
    """WITH {preds} SELECT item_id, CASE WHEN item_id % 40 = 7 THEN 'left' WHEN item_id % 40 = 9 THEN 'right' ELSE '' END AS missing_in,
    CASE WHEN item_id % 40 IN (7, 9) THEN NULL WHEN item_id % 10 = 0 THEN abs(confidence - (confidence + 0.25::DOUBLE)) ELSE 0.0::DOUBLE END AS max_abs_difference,
    item_id % 25 <> 1 AND item_id % 40 NOT IN (7, 9) AS same_predicted, item_id % 40 NOT IN (7, 9) AS same_split,
    CASE WHEN item_id % 25 <> 1 AND item_id % 10 <> 0 AND item_id % 40 NOT IN (7, 9) THEN 'PASS' ELSE 'FAIL' END AS status FROM preds""",
)
def d8(t):
    a = predictions(t).select("item_id", "predicted", "split", "probabilities")
    moved = F.transform("probabilities", lambda x: F.when(x == F.array_max("probabilities"), x + F.lit(0.25)).otherwise(x))
    b = a.select(
        "item_id",
        F.when(F.col("item_id") % 25 == 1, "other").otherwise(F.col("predicted")).alias("predicted"),
        "split",
        F.when(F.col("item_id") % 10 == 0, moved).otherwise(F.col("probabilities")).alias("probabilities"),
    )
    # some items are missing from one run or the other
    a, b = a.filter("item_id % 40 <> 7"), b.filter("item_id % 40 <> 9")
    return joins.compare_runs(a, b, "item_id", "probabilities", ["predicted", "split"], 1e-5)


@query(
    "d8_run_equivalence_maximum",
    "WITH {preds} SELECT max(abs(confidence - (confidence + 0.25::DOUBLE))) AS max_abs_difference FROM preds WHERE item_id % 10 = 0",
)
def d8_max(t):
    return d8(t).agg(F.max("max_abs_difference").alias("max_abs_difference"))


@query(
    "d9_missing_evidence",
    """WITH need AS (SELECT page_id, trim(unnest(string_split('src' || (page_id % 30) || '; src' || (page_id % 7) || ' ;', ';'))) AS evidence FROM pages)
    SELECT DISTINCT page_id, evidence FROM need WHERE evidence <> '' AND evidence NOT IN (SELECT source FROM documents)""",
)
def d9(t):
    wanted = F.concat(
        F.lit("src"), (F.col("page_id") % 30).cast("string"), F.lit("; src"), (F.col("page_id") % 7).cast("string"), F.lit(" ;")
    )
    rows = joins.listed_items(t.pages.select("page_id", wanted.alias("list")), "list", "evidence")
    known = t.documents.select(F.col("source").alias("evidence"))
    return joins.missing_references(rows.select("page_id", "evidence").distinct(), known, "evidence").select("page_id", "evidence")


# Fixed lookup of this binding.
LANGUAGE_NAMES = {"de": "German", "en": "English", "fr": "French"}


@query(
    "d10_lookup",
    """SELECT doc_id, CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE '' END AS language FROM documents""",
)
def d10(t):
    return t.documents.select("doc_id", joins.lookup_constant(F.col("lang"), LANGUAGE_NAMES).alias("language"))


SQL_TOP_TEXTS = "top AS (SELECT item_text FROM manifest GROUP BY item_text ORDER BY count(*) DESC, item_text LIMIT 15)"


def top_texts(t, n: int = 15):
    return (
        manifest(t)
        .groupBy("item_text")
        .agg(F.count(F.lit(1)).alias("items"))
        .orderBy(F.desc("items"), "item_text")
        .limit(n)
    )


@query(
    "d11_restrict_to_top_keys",
    "WITH {manifest}, " + SQL_TOP_TEXTS + " SELECT item_text, target, count(*)::BIGINT AS items FROM manifest WHERE item_text IN (SELECT item_text FROM top) GROUP BY item_text, target",
)
def d11(t):
    cells = manifest(t).groupBy("item_text", "target").agg(F.count(F.lit(1)).alias("items"))
    # the right side is a limit of 15 rows
    return cells.join(F.broadcast(top_texts(t).select("item_text")), "item_text", "left_semi")


@query(
    "d12_keyword_matrix",
    """WITH k AS (SELECT unnest(['the', 'und', 'Les', 'copyright', '@']) AS keyword)
    SELECT doc_id, keyword, CASE WHEN contains(lower(text), lower(keyword)) THEN 'PASS' ELSE 'WARN' END AS status FROM documents, k""",
)
def d12(t):
    return joins.keyword_matrix(t.documents, "doc_id", "text", ["the", "und", "Les", "copyright", "@"])


# --- counts ------------------------------------------------------------------


@query(
    "e1_counts_with_total",
    """WITH {manifest} SELECT target, count(*)::BIGINT AS items, count(DISTINCT entity)::BIGINT AS entities,
    count(*) / (SELECT count(*) FROM manifest) AS share_of_total FROM manifest GROUP BY target""",
)
def e1(t):
    profile.counts_with_entities(manifest(t), ["target"], "entity").createOrReplaceTempView("labelproof_target_counts")
    return t.spark.sql(
        "SELECT target, items, entities, items / (SELECT sum(items) FROM labelproof_target_counts) AS share_of_total "
        "FROM labelproof_target_counts"
    )


@query(
    "e2_two_key_distinct",
    "WITH {manifest} SELECT target, split, count(DISTINCT entity)::BIGINT AS entities FROM manifest GROUP BY target, split",
)
def e2(t):
    return profile.distinct_counts(manifest(t), ["target", "split"], "entity")


@query(
    "e3_crosstab",
    "WITH {docs} SELECT entity, " + ", ".join(f"count(*) FILTER (WHERE target = '{c}')::BIGINT AS n_{c}" for c in LANGUAGES) + " FROM docs GROUP BY entity",
)
def e3(t):
    return reshape.crosstab(docs(t), "entity", "target", LANGUAGES, prefix="n_")


SQL_MAP = "(SELECT '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' FROM (SELECT {key} AS k, {measure} AS n FROM leaky GROUP BY {key}))"


@query(
    "e4_structure_profile",
    """WITH {leaky}, pe AS (SELECT entity, count(*) AS n, count(DISTINCT split) AS s FROM leaky GROUP BY entity)
    SELECT (SELECT count(*) FROM leaky)::BIGINT AS total_items, (SELECT count(DISTINCT item_id) FROM leaky)::BIGINT AS unique_keys,
      (SELECT count(*) FROM pe)::BIGINT AS unique_entities, (SELECT count(*) FROM pe WHERE s > 1)::BIGINT AS entity_overlap_count,
      (SELECT min(n) FROM pe)::BIGINT AS items_per_entity_min, (SELECT max(n) FROM pe)::BIGINT AS items_per_entity_max, """
    + ", ".join(
        SQL_MAP.format(key=k, measure=m) + f" AS {n}"
        for k, m, n in (
            ("target", "count(*)", "items_per_target"),
            ("split", "count(*)", "items_per_split"),
            ("target", "count(DISTINCT entity)", "entities_per_target"),
            ("split", "count(DISTINCT entity)", "entities_per_split"),
        )
    ),
)
def e4(t):
    p = profile.structure_profile(leaky_manifest(t), "item_id", "entity", "target", "split")
    maps = [c for c in p.columns if c.startswith(("items_per_target", "items_per_split", "entities_per_"))]
    return p.select(*[F.to_json(c).alias(c) if c in maps else F.col(c) for c in p.columns])


@query(
    "e5_effect_rates",
    f"""WITH {{effects}}, f AS (SELECT target, actual_font_size, rotation_degrees, blur_radius, jpeg_quality, {SQL_FLAGS} FROM effects)
    SELECT target, {", ".join(f"count(*) FILTER (WHERE {n}) / count(*) AS {n}" for n in FLAGS)},
    round(avg(actual_font_size), 6) AS mean_actual_font_size, round(avg(rotation_degrees), 6) AS mean_rotation_degrees,
    round(avg(blur_radius), 6) AS mean_blur_radius, round(avg(jpeg_quality), 6) AS mean_jpeg_quality FROM f GROUP BY target""",
)
def e5(t):
    means = ["actual_font_size", "rotation_degrees", "blur_radius", "jpeg_quality"]
    table = balance.rates_and_means(expanded_effects(t), "target", effect_flags(), means)
    return table.select("target", *FLAGS, *[F.round(f"mean_{m}", 6).alias(f"mean_{m}") for m in means])


@query(
    "e6_rate_spreads",
    f"""WITH {{effects}}, f AS (SELECT target, {SQL_FLAGS} FROM effects),
    r AS (SELECT target, {", ".join(f"count(*) FILTER (WHERE {n}) / count(*) AS {n}" for n in FLAGS)} FROM f GROUP BY target),
    s AS (SELECT {", ".join(f"max({n}) - min({n}) AS spread_{n}" for n in FLAGS)} FROM r)
    SELECT *, greatest({", ".join(f"spread_{n}" for n in FLAGS)}) AS max_spread, greatest({", ".join(f"spread_{n}" for n in FLAGS)}) > 0.05 AS serious FROM s""",
)
def e6(t):
    return balance.rate_spreads(balance.rates_and_means(expanded_effects(t), "target", effect_flags(), []), FLAGS)


SQL_MMM = """x AS (SELECT l_returnflag AS g, 'l_quantity' AS metric, l_quantity AS v FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem)"""


@query(
    "e7_min_median_max",
    "WITH " + SQL_MMM + """ SELECT g AS l_returnflag, metric, min(v) AS minimum, max(v) AS maximum, round(median(v), 6) AS median FROM x GROUP BY g, metric""",
)
def e7(t):
    out = profile.min_median_max(t.lineitem, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("median", F.round("median", 6))


@query(
    "e7_min_median_max_nan",
    """WITH x AS (SELECT l_returnflag AS g, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS v FROM lineitem)
    SELECT g AS l_returnflag, 'l_quantity' AS metric, min(v) AS minimum, max(v) AS maximum, round(median(v), 6) AS median FROM x GROUP BY g""",
)
def e7_nan(t):
    rows = t.lineitem.withColumn("l_quantity", F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_quantity")))
    return profile.min_median_max(rows, ["l_returnflag"], ["l_quantity"]).withColumn("median", F.round("median", 6))


@query(
    "e7_min_median_max_overall",
    "WITH " + SQL_MMM + """ SELECT metric, min(v) AS minimum, max(v) AS maximum, round(median(v), 6) AS median FROM x GROUP BY metric""",
)
def e7_all(t):
    out = profile.min_median_max(t.lineitem, [], ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("median", F.round("median", 6))


@query(
    "e8_min_avg_max_filtered",
    """SELECT l_linestatus, count(*)::BIGINT AS rows, min(l_quantity) AS min_quantity, round(avg(l_quantity), 6) AS avg_quantity, max(l_quantity) AS max_quantity,
    min(l_discount) AS min_discount, round(avg(l_discount), 6) AS avg_discount, max(l_discount) AS max_discount,
    min(l_tax) AS min_tax, round(avg(l_tax), 6) AS avg_tax, max(l_tax) AS max_tax
    FROM lineitem WHERE l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY l_linestatus""",
)
def e8(t):
    t.lineitem.createOrReplaceTempView("labelproof_lineitem")
    measures = ", ".join(
        f"min(l_{m}) AS min_{m}, round(avg(l_{m}), 6) AS avg_{m}, max(l_{m}) AS max_{m}" for m in ("quantity", "discount", "tax")
    )
    return t.spark.sql(
        f"SELECT l_linestatus, count(*) AS rows, {measures} FROM labelproof_lineitem "
        "WHERE l_returnflag <> :flag AND l_shipdate >= TIMESTAMP_NTZ '1999-01-01' GROUP BY l_linestatus",
        args={"flag": "R"},
    )


@query(
    "e9_conditional_counts",
    """WITH {effects} SELECT target, count(*)::BIGINT AS items, count(*) FILTER (WHERE background = 'light')::BIGINT AS light_background,
    count(*) FILTER (WHERE background = 'dark')::BIGINT AS dark_background, count(*) FILTER (WHERE jpeg_quality IS NOT NULL)::BIGINT AS jpeg_compression,
    count(*) FILTER (WHERE abs(rotation_degrees) > 0)::BIGINT AS mild_rotation, round(avg(actual_font_size), 6) AS mean_actual_font_size,
    min(luminance_difference) AS minimum_luminance_difference FROM effects GROUP BY target""",
)
def e9(t):
    conditions = {
        "light_background": F.col("background") == "light",
        "dark_background": F.col("background") == "dark",
        "jpeg_compression": F.col("jpeg_quality").isNotNull(),
        "mild_rotation": F.abs("rotation_degrees") > 0,
    }
    out = balance.conditional_counts(
        expanded_effects(t), "target", conditions, mean="actual_font_size", minimum="luminance_difference"
    )
    return out.withColumn("mean_actual_font_size", F.round("mean_actual_font_size", 6))


@query(
    "e10_unequal_multisets",
    """WITH {effects}, b AS (SELECT target, item_text AS v, count(*) AS n FROM effects GROUP BY 1, 2), ref AS (SELECT v, n FROM b WHERE target = 'click')
    SELECT b.target, count(*)::BIGINT AS values, count(*) FILTER (WHERE b.n = ref.n)::BIGINT AS equal_values, (SELECT count(*) FROM ref)::BIGINT AS reference_values
    FROM b LEFT JOIN ref ON b.v = ref.v WHERE b.target <> 'click' GROUP BY b.target
    HAVING count(*) FILTER (WHERE b.n = ref.n) < greatest(count(*), (SELECT count(*) FROM ref))""",
)
def e10(t):
    return balance.unequal_multisets(manifest(t), "target", "item_text", "click")


@query(
    "e10_unequal_signatures",
    """WITH {effects}, g AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS target, background || '/' || contrast_style AS v FROM effects),
    b AS (SELECT target, v, count(*) AS n FROM g GROUP BY 1, 2), ref AS (SELECT v, n FROM b WHERE target = 'even')
    SELECT b.target, count(*)::BIGINT AS values, count(*) FILTER (WHERE b.n = ref.n)::BIGINT AS equal_values, (SELECT count(*) FROM ref)::BIGINT AS reference_values
    FROM b LEFT JOIN ref ON b.v = ref.v WHERE b.target <> 'even' GROUP BY b.target
    HAVING count(*) FILTER (WHERE b.n = ref.n) < greatest(count(*), (SELECT count(*) FROM ref))""",
)
def e10_signatures(t):
    parsed = tx.parse_struct(F.col("effects_json"), EFFECTS)
    rows = effects(t).select(
        F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("target"),
        tx.signature(parsed, ("background", "contrast_style")).alias("signature"),
    )
    return balance.unequal_multisets(rows, "target", "signature", "even")


@query("e11_duplicate_keys", "SELECT ts::DATE::VARCHAR || '/' || user_id AS natural_key, count(*)::BIGINT AS rows FROM events GROUP BY 1 HAVING count(*) > 1")
def e11(t):
    keyed = t.events.select(F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string")).alias("natural_key"))
    return profile.duplicate_keys(keyed, "natural_key")


@query(
    "e12_duplicate_content_groups",
    """SELECT count(*)::BIGINT AS duplicate_groups, coalesce(sum(n), 0)::BIGINT AS rows_in_groups
    FROM (SELECT sha256(text) AS d, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)""",
)
def e12(t):
    return profile.duplicate_groups(t.documents, F.sha2("text", 256))


@query(
    "e13_duplicate_rows",
    """SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_rows
    FROM (SELECT COLUMNS(*), count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 2) GROUP BY ALL)""",
)
def e13(t):
    return profile.duplicate_row_count(t.lineitem.unionByName(t.lineitem.filter("l_linenumber = 2")))


@query(
    "e14_leaked_entities",
    "WITH {leaky} SELECT entity, count(DISTINCT split)::BIGINT AS splits FROM leaky GROUP BY entity HAVING count(DISTINCT split) > 1",
)
def e14(t):
    return profile.leaked_entities(leaky_manifest(t), "entity", "split")


@query(
    "e14_no_leak_in_entity_split",
    "WITH {manifest} SELECT entity, count(DISTINCT split)::BIGINT AS splits FROM manifest GROUP BY entity HAVING count(DISTINCT split) > 1",
)
def e14_clean(t):
    return profile.leaked_entities(manifest(t), "entity", "split")


@query(
    "e26_audit_summary",
    """WITH {catalogue}, a AS (SELECT CASE WHEN entity_id % 11 = 0 THEN '' ELSE entity END AS entity, target AS listed, CASE WHEN entity_id % 13 = 0 THEN 'BUILDING' ELSE target END AS actual,
      lower(usable) IN ('true','1') AS ok FROM catalogue),
    s AS (SELECT unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY','NONE']) AS target)
    SELECT s.target, (SELECT count(DISTINCT nullif(entity, '')) FROM a WHERE ok AND actual = s.target)::BIGINT AS usable_entities,
      (SELECT count(*) FROM a WHERE NOT ok AND listed = s.target)::BIGINT AS failed_entries, (SELECT count(*) FROM a WHERE listed = s.target)::BIGINT AS audited_entries FROM s""",
)
def e26(t):
    audit = catalogue(t).select(
        F.when(F.col("entity_id") % 11 == 0, "").otherwise(F.col("entity")).alias("entity"),
        F.col("target").alias("listed"),
        F.when(F.col("entity_id") % 13 == 0, "BUILDING").otherwise(F.col("target")).alias("actual"),
        "usable",
    )
    return profile.audit_summary(audit, [*SEGMENTS, "NONE"], entity="entity", actual="actual", listed="listed", usable="usable")


@query(
    "e27_contingency",
    """WITH {manifest}, c AS (SELECT item_text AS value, target, count(*)::BIGINT AS items FROM manifest GROUP BY 1, 2)
    SELECT value, target, items, items / sum(items) OVER (PARTITION BY target) AS rate FROM c""",
)
def e27(t):
    return balance.contingency(manifest(t), "item_text", "target")


SQL_ASSOC = """cells AS (SELECT {v} AS v, {g} AS g, count(*)::DOUBLE AS o FROM {src} GROUP BY 1, 2),
  r AS (SELECT v, sum(o) AS r FROM cells GROUP BY v), c AS (SELECT g, sum(o) AS c FROM cells GROUP BY g), n AS (SELECT sum(o) AS n FROM cells),
  dense AS (SELECT r.v, c.g, coalesce(o, 0) AS o, r.r, c.c, r.r * c.c / n.n AS e FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN cells ON cells.v = r.v AND cells.g = c.g),
  chi AS (SELECT sum((o - e) * (o - e) / e) AS x FROM dense),
  sp AS (SELECT v, max(o / c) - min(o / c) AS s FROM dense GROUP BY v)
  SELECT (SELECT count(*) FROM r)::BIGINT AS unique_values, round(sqrt((SELECT x FROM chi) / ((SELECT n FROM n) * least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM c) - 1))), 6) AS cramers_v,
    (SELECT max(s) FROM sp) AS max_rate_spread,
    sqrt((SELECT x FROM chi) / ((SELECT n FROM n) * least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM c) - 1))) >= 0.3 AS strong"""


@query("e28_association", "WITH {manifest}, " + SQL_ASSOC.format(v="item_text", g="target", src="manifest"))
def e28(t):
    return balance.association(manifest(t), "item_text", "target").withColumn("cramers_v", F.round("cramers_v", 6))


@query("e28_association_part", "WITH " + SQL_ASSOC.format(v="p_brand", g="p_type", src="part"))
def e28_part(t):
    return balance.association(t.part, "p_brand", "p_type").withColumn("cramers_v", F.round("cramers_v", 6))


@query(
    "e29_rate_spread_orders",
    "WITH " + SQL_ASSOC.format(v="o_orderpriority", g="o_orderstatus", src="orders"),
)
def e29(t):
    return balance.association(t.orders, "o_orderpriority", "o_orderstatus").withColumn("cramers_v", F.round("cramers_v", 6))


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", '{d}' AS dtype, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS nulls, "
        f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM {table}))::BIGINT AS distinct_values, count(*)::BIGINT AS rows, "
        f"coalesce((count(*) FILTER (WHERE {c} IS NULL) * 100) / nullif(count(*), 0), 0)::DOUBLE AS null_percent FROM {table}"
        for c, d in columns.items()
    ]
    return " UNION ALL ".join(parts)


EVENT_COLUMNS = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "odd_value": "double", "kind": "string"}
SQL_WITH_NULLS = "WITH wide AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS odd_value, 'event' AS kind FROM events) "


def with_nulls(t):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value"))
    return t.events.select("event_id", "user_id", "event_type", "value", odd.alias("odd_value"), F.lit("event").alias("kind"))


@query("e30_column_profile", SQL_WITH_NULLS + _profile_sql("wide", EVENT_COLUMNS))
def e30(t):
    return profile.column_profile(with_nulls(t))


@query(
    "e30_column_profile_lineitem",
    _profile_sql(
        "lineitem",
        {
            "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
            "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
            "l_shipdate": "timestamp_ntz",
        },
    ),
)
def e30_lineitem(t):
    return profile.column_profile(t.lineitem)


@query("e31_constant_columns", SQL_WITH_NULLS + "SELECT 'kind' AS \"column\" FROM wide GROUP BY ALL HAVING count(DISTINCT kind) <= 1")
def e31(t):
    return profile.constant_columns(profile.column_profile(with_nulls(t)))


@query("e31_identifier_like", SQL_WITH_NULLS + "SELECT unnest(['event_id', 'user_id']) AS \"column\", (SELECT count(*) FROM wide)::BIGINT AS rows")
def e31_ids(t):
    frame = with_nulls(t)
    names = reshape.literals(t.spark, profile.identifier_like(frame.columns), "column")
    return names.withColumn("rows", frame.agg(F.count(F.lit(1))).scalar())


@query(
    "e32_target_distribution",
    "SELECT toxic AS target, count(*)::BIGINT AS count, (count(*) * 100) / sum(count(*)) OVER () AS percent FROM labels GROUP BY toxic",
)
def e32(t):
    return profile.target_distribution(t.labels, "toxic")


@query(
    "e32_imbalance",
    """WITH d AS (SELECT toxic, (count(*) * 100) / sum(count(*)) OVER () AS p FROM labels GROUP BY toxic)
    SELECT count(*)::BIGINT AS values, min(p) AS smallest_percent, CASE WHEN count(*) = 2 AND min(p) < 15 THEN 'WARN' ELSE 'PASS' END AS status FROM d""",
)
def e32_status(t):
    return profile.imbalance_status(profile.target_distribution(t.labels, "toxic"))


@query(
    "e33_target_share_by_side",
    """WITH {manifest}, s AS (SELECT target, CASE WHEN split = 'train' THEN 1 ELSE 0 END AS tr FROM manifest)
    SELECT target, sum(tr) / (SELECT sum(tr) FROM s) AS train, sum(1 - tr) / (SELECT sum(1 - tr) FROM s) AS validation FROM s GROUP BY target""",
)
def e33(t):
    return profile.target_share_by_side(manifest(t), "target")


@query(
    "e34_time_boundary",
    """WITH {manifest} SELECT max(ts) FILTER (WHERE split = 'train') AS train_max, min(ts) FILTER (WHERE split <> 'train') AS validation_min,
    coalesce(max(ts) FILTER (WHERE split = 'train') < min(ts) FILTER (WHERE split <> 'train'), TRUE) AS chronological FROM manifest""",
)
def e34(t):
    return profile.time_boundary(manifest(t), "ts")


@query(
    "e34_time_boundary_orders",
    """WITH o AS (SELECT o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'val' END AS split FROM orders)
    SELECT max(o_orderdate) FILTER (WHERE split = 'train') AS train_max, min(o_orderdate) FILTER (WHERE split = 'val') AS validation_min,
    coalesce(max(o_orderdate) FILTER (WHERE split = 'train') < min(o_orderdate) FILTER (WHERE split = 'val'), TRUE) AS chronological FROM o""",
)
def e34_orders(t):
    boundary = F.lit("2000-01-01").cast("timestamp_ntz")
    return profile.time_boundary(
        t.orders.select("o_orderdate", F.when(F.col("o_orderdate") < boundary, "train").otherwise("val").alias("split")), "o_orderdate"
    )


@query(
    "e35_text_check",
    """WITH x AS (SELECT trim(coalesce(CASE WHEN doc_id % 20 = 0 THEN '   ' WHEN doc_id % 20 = 1 THEN NULL ELSE text END, '')) AS v FROM documents)
    SELECT count(*) FILTER (WHERE v = '')::BIGINT AS empty_texts, (count(*) - count(DISTINCT v))::BIGINT AS duplicate_texts FROM x""",
)
def e35(t):
    r = F.col("doc_id") % 20
    body = F.when(r == 0, "   ").when(r == 1, F.lit(None)).otherwise(F.col("text"))
    return profile.text_check(t.documents.select(body.alias("text")), "text")


@query(
    "e36_scale_ratio",
    """WITH s AS (SELECT unnest([stddev_samp(l_orderkey), stddev_samp(l_partkey), stddev_samp(l_suppkey), stddev_samp(l_linenumber),
      stddev_samp(l_quantity), stddev_samp(l_extendedprice), stddev_samp(l_discount), stddev_samp(l_tax)]) AS d FROM lineitem)
    SELECT round(max(d) / min(d), 2) AS scale_ratio, CASE WHEN max(d) / min(d) > 100 THEN 'WARN' ELSE 'PASS' END AS status FROM s WHERE d <> 0""",
)
def e36(t):
    return profile.scale_ratio(t.lineitem).withColumn("scale_ratio", F.round("scale_ratio", 2))


def effect_positions(t):
    """Rank of each item inside its target, by item key, split into (rank, index) positions of 40."""
    items = expanded_effects(t).select("item_id", "target", "actual_font_size")
    draw = hash_draw(7, "item_id")
    sliced = items.withColumn("draw", draw).withColumn(SLICE, draw_slice(F.col("draw")))
    ranked = numbered(sliced, ["target"], ["draw", "item_id"])
    zero = F.col("rank") - 1
    return ranked.select("target", "actual_font_size", F.floor(zero / 40).alias("position"), (zero % 40).alias("index"))


@query(
    "e37_minimum_schedule",
    """WITH {effects}, r AS (SELECT target, actual_font_size, row_number() OVER (PARTITION BY target ORDER BY sha256('7|' || item_id::VARCHAR), item_id) - 1 AS z FROM effects)
    SELECT z // 40 AS position, z % 40 AS index, min(actual_font_size) AS scheduled, count(DISTINCT target)::BIGINT AS targets, count(*)::BIGINT AS rows,
    count(DISTINCT target) = 5 AND count(*) = 5 AS complete FROM r GROUP BY 1, 2""",
)
def e37(t):
    return balance.minimum_schedule(effect_positions(t), ["position", "index"], "actual_font_size", "target", len(CLASSES))
