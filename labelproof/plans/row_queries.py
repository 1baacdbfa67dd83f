"""Row-level queries: filters, rule chains, decisions, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.functions import text as tx
from labelproof.functions import vectors as vx
from labelproof.operators import rules
from labelproof.operators.rules import Rule
from labelproof.operators.reshape import leading_columns
from labelproof.plans.bindings import CLASSES, catalogue, docs, effects, manifest, predictions
from labelproof.plans.registry import query
from labelproof.schemas import EFFECTS

EFFECT_NAMES = tuple(f.name for f in EFFECTS.fields)


def expanded_effects(t):
    parsed = effects(t).withColumn("e", tx.parse_struct(F.col("effects_json"), EFFECTS))
    return parsed.select("item_id", "entity", "target", "split", "item_text", "k", "value", "e.*")


@query("a2_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def a2(t):
    return t.lineitem.filter(F.col("l_quantity") > 49).select("l_orderkey", "l_quantity")


@query("a3_split_restricted_scan", "WITH {manifest} SELECT item_id, entity, target, split FROM manifest WHERE split IN ('train','validation')")
def a3(t):
    kept = rules.require_splits(manifest(t), ("train", "validation"))
    return kept.select("item_id", "entity", "target", "split")


@query("b1_truthy_filter", "WITH {catalogue} SELECT entity_id, usable FROM catalogue WHERE lower(usable) IN ('true','1')")
def b1(t):
    return catalogue(t).filter(rules.is_true_text("usable")).select("entity_id", "usable")


@query(
    "b2_blank_required_rows",
    """WITH x AS (SELECT conv_id, turn, trim(coalesce(role, '')) AS role,
      trim(coalesce(CASE WHEN turn % 4 = 3 THEN '  ' ELSE text END, '')) AS lead,
      coalesce(CASE WHEN turn % 5 = 4 THEN NULL ELSE role END, '') AS speaker FROM conversations)
    SELECT conv_id, turn, CASE WHEN lead = '' AND speaker = '' THEN 'lead,speaker' WHEN lead = '' THEN 'lead' ELSE 'speaker' END AS blank_columns
    FROM x WHERE lead = '' OR speaker = ''""",
)
def b2(t):
    rows = t.conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.col("text")).alias("lead"),
        F.when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(F.col("role")).alias("speaker"),
    )
    return rules.blank_rows(rows, ["lead", "speaker"]).select("conv_id", "turn", "blank_columns")


@query("b3_filter_split", "WITH {manifest} SELECT item_id, target FROM manifest WHERE split = 'validation'")
def b3(t):
    return rules.one_split(manifest(t), "validation").select("item_id", "target")


@query("b4_required_columns", "WITH {manifest} SELECT item_id, entity, target, split FROM manifest")
def b4(t):
    frame = manifest(t)
    rules.require_columns(frame, ["item_id", "entity", "target", "split"])
    return frame.select("item_id", "entity", "target", "split")


@query(
    "b5_unexpected_values",
    """SELECT event_type AS value, count(*)::BIGINT AS rows FROM events
    WHERE event_type NOT IN ('click','view','signup') GROUP BY event_type""",
)
def b5(t):
    return rules.unexpected_values(t.events, "event_type", ("click", "view", "signup"))


@query(
    "b5_targets_unseen_in_train",
    """WITH {docs}, v AS (SELECT DISTINCT entity FROM docs WHERE split = 'validation'), tr AS (SELECT DISTINCT entity FROM docs WHERE split = 'train')
    SELECT entity FROM v WHERE entity NOT IN (SELECT entity FROM tr)""",
)
def b5_unseen(t):
    d = docs(t)
    return rules.values_missing_from(d.filter("split = 'validation'"), d.filter("split = 'train'"), "entity")


PAGE_RULES_SQL = """
CASE WHEN html IS NULL OR trim(html) = '' THEN 'empty page'
     WHEN NOT starts_with(url, 'https://') THEN 'insecure scheme: ' || split_part(url, ':', 1)
     WHEN contains(url, '?') THEN 'query string in address'
     WHEN regexp_extract(html, '<html lang="([^"]+)"', 1) = '' THEN 'no language attribute'
     WHEN regexp_extract(html, '<html lang="([^"]+)"', 1) NOT IN ('en','fr','de','es') THEN 'unsupported language'
     WHEN regexp_extract(html, '<html lang="([^"]+)"', 1) <> regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) THEN 'language does not match address'
     ELSE '' END
"""


def page_rules():
    lang = tx.first_match(F.col("html"), '<html lang="([^"]+)"')
    path_lang = tx.first_match(F.col("url"), "^https?://[^/]+/([a-z]{2})/")
    return [
        Rule(F.col("html").isNull() | (F.trim("html") == ""), "empty page"),
        Rule(
            ~F.col("url").startswith("https://"),
            F.concat(F.lit("insecure scheme: "), F.split_part("url", F.lit(":"), F.lit(1))),
        ),
        Rule(F.col("url").contains("?"), "query string in address"),
        Rule(lang == "", "no language attribute"),
        Rule(~lang.isin("en", "fr", "de", "es"), "unsupported language"),
        Rule(lang != path_lang, "language does not match address"),
    ]


@query("b6_first_failure_rules", f"SELECT page_id, ({PAGE_RULES_SQL}) AS reason, ({PAGE_RULES_SQL}) = '' AS usable FROM pages")
def b6(t):
    return rules.first_failure(t.pages, page_rules()).select("page_id", "reason", "usable")


SQL_FLAGS = """
  background = 'dark' AS dark_background, contrast_style = 'soft' AS soft_contrast, blur_radius IS NOT NULL AS blur_applied,
  jpeg_quality IS NOT NULL AS jpeg_applied, letter_spacing_px <> 0 AS letter_spacing_applied, abs(rotation_degrees) > 0 AS rotation_applied,
  horizontal_shift_px <> 0 AS horizontal_shift_applied, vertical_shift_px <> 0 AS vertical_shift_applied, scale_factor <> 1.0::DOUBLE AS scaling_applied
"""


@query("b7_effect_flags", f"WITH {{effects}} SELECT item_id, {SQL_FLAGS} FROM effects")
def b7(t):
    flags = rules.effect_flags()
    return expanded_effects(t).select("item_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "b10_decision",
    """WITH {preds} SELECT item_id, predicted, confidence, confidence >= 0.7 AS accepted, NOT confidence >= 0.7 AS uncertain,
    CASE WHEN confidence >= 0.7 THEN '' ELSE 'low confidence: treat as an uncertain first guess' END AS warning FROM preds""",
)
def b10(t):
    out = rules.decide(predictions(t), 0.7)
    return out.select("item_id", "predicted", "confidence", "accepted", "uncertain", "warning")


@query(
    "b11_prediction_frame",
    "WITH {preds} SELECT item_id, entity, truth, predicted, confidence, correct, "
    + ", ".join(f"CASE WHEN predicted = '{c}' THEN confidence ELSE rest END AS probability_{c}" for c in CLASSES)
    + " FROM preds",
)
def b11(t):
    scored = predictions(t).drop("predicted", "confidence", "correct")
    return rules.prediction_frame(scored, ["item_id", "entity"], CLASSES)


@query("b12_leading_columns", "WITH {catalogue} SELECT target, entity, entity_id, path, source, license, usable, balance FROM catalogue")
def b12(t):
    return leading_columns(catalogue(t), ["target", "entity"])


# Fixed marker list for the inventory check of this binding.
FORBIDDEN_MARKERS = ("nation_1", "brand#1", ".env", "id_rsa")


@query(
    "b13_inventory_lint",
    """WITH files AS (SELECT DISTINCT lower(p_brand || '/' || p_type || '/' || p_name || CASE WHEN p_size % 7 = 0 THEN '.key' ELSE '.bin' END) AS name FROM part),
    wanted AS (SELECT unnest(['readme.txt', 'brand#2/economy/small ring.bin', 'brand#99/none.bin']) AS name)
    SELECT name, 'missing' AS finding FROM wanted WHERE name NOT IN (SELECT name FROM files)
    UNION ALL
    SELECT name, 'forbidden' FROM files WHERE contains(name, 'nation_1') OR contains(name, 'brand#1') OR contains(name, '.env') OR contains(name, 'id_rsa')
      OR name LIKE '%.key'""",
)
def b13(t):
    ending = F.when(F.col("p_size") % 7 == 0, ".key").otherwise(".bin")
    files = t.part.select(F.lower(F.concat(F.concat_ws("/", "p_brand", "p_type", "p_name"), ending)).alias("name")).distinct()
    required = ["readme.txt", "brand#2/economy/small ring.bin", "brand#99/none.bin"]
    return rules.inventory_lint(files, required, FORBIDDEN_MARKERS, [r"\.key$"])


@query(
    "c1_slugs",
    """SELECT p_partkey, trim(regexp_replace(p_brand || ' ' || p_name || '!', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS safe_slug,
    trim(regexp_replace(lower(p_brand || ' ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS lower_slug FROM part""",
)
def c1(t):
    raw = F.concat(F.concat_ws(" ", "p_brand", "p_name"), F.lit("!"))
    return t.part.select("p_partkey", tx.safe_slug(raw).alias("safe_slug"), tx.lower_slug(raw).alias("lower_slug"))


@query("c2_entity_key", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS entity_key FROM customer")
def c2(t):
    return t.customer.select("c_custkey", tx.entity_key(F.col("c_name")).alias("entity_key"))


@query(
    "c3_display_labels",
    """WITH x AS (SELECT event_id, event_type || '_' || CASE WHEN event_id % 2 = 0 THEN 'ROW' ELSE 'item' END AS label FROM events)
    SELECT event_id, upper(substr(replace(label, '_', ' '), 1, 1)) || lower(substr(replace(label, '_', ' '), 2)) AS display,
      upper(substr(split_part(label, '_', 1), 1, 1)) || lower(substr(split_part(label, '_', 1), 2)) || ' ' ||
      upper(substr(split_part(label, '_', 2), 1, 1)) || lower(substr(split_part(label, '_', 2), 2)) AS title FROM x""",
)
def c3(t):
    label = F.concat_ws("_", "event_type", F.when(F.col("event_id") % 2 == 0, "ROW").otherwise("item"))
    return t.events.select("event_id", tx.display_label(label).alias("display"), tx.title_label(label).alias("title"))


@query(
    "c4_field_extraction",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    regexp_extract(html, '<html lang="([^"]+)"', 1) AS lang,
    len(regexp_extract_all(html, '<a href="([^"]+)"', 1))::BIGINT AS links,
    array_to_string(regexp_extract_all(html, '<a href="([^"]+)"', 1), ' ') AS link_list FROM pages""",
)
def c4(t):
    html = F.col("html")
    links = tx.every_match(html, '<a href="([^"]+)"')
    return t.pages.select(
        "page_id",
        tx.first_match(html, "<title>([^<]*)</title>").alias("title"),
        tx.first_match(html, '<html lang="([^"]+)"').alias("lang"),
        F.size(links).cast("bigint").alias("links"),
        F.array_join(links, " ").alias("link_list"),
    )


@query(
    "c4_metadata_record",
    """WITH {catalogue}, rec AS (SELECT entity_id, 'name: "' || entity || '"' || chr(10) || 'license: "' || license || '"' || chr(10) || 'category: "' || target || '"'
      || chr(10) || 'fonts { filename: "' || entity_id || '-Regular.ttf" }' || chr(10) || 'fonts { filename: "' || entity_id || '-Italic.ttf" }' || chr(10)
      || 'subsets: "latin"' || chr(10) || 'subsets: "greek"' AS body FROM catalogue)
    SELECT entity_id, regexp_extract(body, 'name:\\s*"([^"]+)"', 1) AS name, regexp_extract(body, 'category:\\s*"([^"]+)"', 1) AS category,
      regexp_extract(body, 'license:\\s*"([^"]+)"', 1) AS license, array_to_string(regexp_extract_all(body, 'filename:\\s*"([^"]+)"', 1), ',') AS filenames,
      array_to_string(regexp_extract_all(body, 'subsets:\\s*"([^"]+)"', 1), ',') AS subsets FROM rec""",
)
def c4_record(t):
    body = F.concat_ws(
        "\n",
        F.format_string('name: "%s"', "entity"),
        F.format_string('license: "%s"', "license"),
        F.format_string('category: "%s"', "target"),
        F.format_string('fonts { filename: "%d-Regular.ttf" }', "entity_id"),
        F.format_string('fonts { filename: "%d-Italic.ttf" }', "entity_id"),
        F.lit('subsets: "latin"'),
        F.lit('subsets: "greek"'),
    )
    rec = catalogue(t).select("entity_id", tx.metadata_fields(body).alias("m"))
    return rec.select(
        "entity_id",
        "m.name",
        "m.category",
        "m.license",
        F.array_join("m.filenames", ",").alias("filenames"),
        F.array_join("m.subsets", ",").alias("subsets"),
    )


# Fixed preference order for picking one file name of several.
PREFERRED_ENDINGS = ("Regular.ttf", "Regular.otf", "[wght].ttf", "-VariableFont_wght.ttf")


@query(
    "c5_preferred_name",
    """WITH x AS (SELECT p_partkey, list_filter([
        CASE WHEN p_size % 2 = 0 THEN 'A-Italic.ttf' END, CASE WHEN p_size % 3 = 0 THEN 'A-Bold.ttf' END,
        CASE WHEN p_size % 5 = 0 THEN 'A[wght].ttf' END, CASE WHEN p_size % 7 = 0 THEN 'A-Regular.otf' END, 'notes.txt'], lambda v: v IS NOT NULL) AS names FROM part),
    y AS (SELECT p_partkey, list_filter(names, lambda v: lower(v) LIKE '%.ttf' OR lower(v) LIKE '%.otf') AS u FROM x)
    SELECT p_partkey, coalesce(list_filter(u, lambda v: ends_with(v, 'Regular.ttf'))[1], list_filter(u, lambda v: ends_with(v, 'Regular.otf'))[1],
      list_filter(u, lambda v: ends_with(v, '[wght].ttf'))[1], list_filter(u, lambda v: ends_with(v, '-VariableFont_wght.ttf'))[1],
      list_filter(u, lambda v: NOT contains(lower(v), 'italic'))[1], u[1]) AS picked FROM y""",
)
def c5(t):
    s = F.col("p_size")
    names = F.array_compact(
        F.array(
            F.when(s % 2 == 0, "A-Italic.ttf"),
            F.when(s % 3 == 0, "A-Bold.ttf"),
            F.when(s % 5 == 0, "A[wght].ttf"),
            F.when(s % 7 == 0, "A-Regular.otf"),
            F.lit("notes.txt"),
        )
    )
    return t.part.select("p_partkey", tx.preferred_name(names, r"\.(ttf|otf)$", PREFERRED_ENDINGS, "italic").alias("picked"))


@query(
    "c6_expand_json",
    "WITH {effects} SELECT item_id, '' AS problem, " + ", ".join(EFFECT_NAMES) + " FROM effects",
)
def c6(t):
    text = F.col("effects_json")
    rows = effects(t).select(
        "item_id", tx.json_problem(text, EFFECT_NAMES).alias("problem"), tx.parse_struct(text, EFFECTS).alias("e")
    )
    return rows.select("item_id", "problem", "e.*")


@query(
    "c6_json_problems",
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 4) WHEN event_id % 50 = 1 THEN NULL ELSE props END AS body FROM events)
    SELECT event_id, CASE WHEN event_id % 50 IN (0, 1) THEN 'invalid JSON' ELSE 'missing fields: z' END AS problem FROM x""",
)
def c6_problems(t):
    r = F.col("event_id") % 50
    body = F.when(r == 0, F.substring("props", 1, 4)).when(r == 1, F.lit(None)).otherwise(F.col("props"))
    return t.events.select("event_id", tx.json_problem(body, ["k", "z"]).alias("problem"))


SIGNATURE_FIELDS = ("background", "contrast_style", "horizontal_shift_px", "jpeg_quality", "letter_spacing_px", "vertical_shift_px")


@query(
    "c7_signature",
    """WITH {effects} SELECT item_id, '{"background":"' || background || '","contrast_style":"' || contrast_style || '","horizontal_shift_px":' ||
    horizontal_shift_px || ',"jpeg_quality":' || coalesce(jpeg_quality::VARCHAR, 'null') || ',"letter_spacing_px":' || letter_spacing_px ||
    ',"vertical_shift_px":' || vertical_shift_px || '}' AS signature FROM effects""",
)
def c7(t):
    parsed = tx.parse_struct(F.col("effects_json"), EFFECTS)
    return effects(t).select("item_id", tx.signature(parsed, SIGNATURE_FIELDS).alias("signature"))


@query("c8_argmax", "WITH {preds} SELECT item_id, predicted AS label, confidence FROM preds")
def c8(t):
    return predictions(t).select(
        "item_id", vx.argmax_label("probabilities", CLASSES).alias("label"), F.array_max("probabilities").alias("confidence")
    )


@query(
    "c9_softmax",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS p FROM embeddings),
    n AS (SELECT vec_id, p, list_sum(p) AS total FROM e)
    SELECT vec_id, i AS dimension, round(p[i + 1] / total, 9) AS p FROM n, unnest(range(0, len(p))) AS u(i)""",
)
def c9(t):
    rows = t.embeddings.select("vec_id", F.posexplode(vx.softmax(F.col("embedding"))).alias("dimension", "p"))
    return rows.select("vec_id", F.col("dimension").cast("bigint").alias("dimension"), F.round("p", 9).alias("p"))


@query(
    "c10_probability_problems",
    """WITH {preds} SELECT item_id, CASE WHEN item_id % 10 = 1 THEN 'wrong length' WHEN item_id % 10 = 2 THEN 'not finite'
    WHEN item_id % 10 = 3 THEN 'sum is not one' WHEN item_id % 10 = 4 AND predicted <> 'view' THEN 'label is not the argmax' ELSE '' END AS problem FROM preds""",
)
def c10(t):
    r = F.col("item_id") % 10
    p = F.col("probabilities")
    broken = (
        F.when(r == 1, F.slice(p, 1, 4))
        .when(r == 2, F.transform(p, lambda x: x / F.lit(0.5) * F.lit(float("nan"))))
        .when(r == 3, F.transform(p, lambda x: x * F.lit(0.5)))
        .otherwise(p)
    )
    label = F.when(r == 4, "view").otherwise(F.col("predicted"))
    return predictions(t).select("item_id", vx.probability_problem(broken, label, CLASSES).alias("problem"))


@query(
    "c13_paths",
    """WITH x AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/srv/data/p' || page_id WHEN page_id % 3 = 1 THEN '/elsewhere/p' || page_id ELSE 'p' || page_id END AS p FROM pages)
    SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/srv/data/' || p END AS resolved,
      CASE WHEN starts_with(p, '/srv/data/') THEN substr(p, 11) ELSE p END AS portable FROM x""",
)
def c13(t):
    r = F.col("page_id") % 3
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    path = F.when(r == 0, F.concat(F.lit("/srv/data/"), name)).when(r == 1, F.concat(F.lit("/elsewhere/"), name)).otherwise(name)
    return t.pages.select("page_id", tx.resolve_path(path, "/srv/data").alias("resolved"), tx.portable_path(path, "/srv/data").alias("portable"))


@query(
    "c14_labels",
    """WITH {preds} SELECT item_id, printf('%.1f–%.1f', (percent // 10)::DOUBLE / 10.0::DOUBLE, (percent // 10 + 1)::DOUBLE / 10.0::DOUBLE) AS range_label,
    percent::VARCHAR || 'x' || k::VARCHAR AS size_label FROM preds""",
)
def c14(t):
    low = F.floor(F.col("percent") / 10)
    return predictions(t).select(
        "item_id",
        tx.range_label(low / F.lit(10.0), (low + 1) / F.lit(10.0)).alias("range_label"),
        tx.size_label(F.col("percent"), F.col("k")).alias("size_label"),
    )


@query(
    "c15_lenient_time",
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'not a date' WHEN event_id % 9 = 1 THEN '2024-13-45' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS s FROM events)
    SELECT event_id, try_cast(s AS TIMESTAMP) AS parsed, try_cast(s AS TIMESTAMP) IS NULL AS bad FROM x""",
)
def c15(t):
    r = F.col("event_id") % 9
    text = F.when(r == 0, "not a date").when(r == 1, "2024-13-45").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = tx.lenient_time(text)
    return t.events.select("event_id", parsed.alias("parsed"), parsed.isNull().alias("bad"))
