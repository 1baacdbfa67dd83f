"""Ranks, sorts, set operations, reshaping and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.operators import digests, evaluation as ev
from labelproof.operators import ranking as rk
from labelproof.operators import reshape as rs
from labelproof.operators import rules
from labelproof.operators import splits as sp
from labelproof.plans.bindings import CLASSES, SEGMENTS, SPLITS, catalogue, docs, manifest, predictions
from labelproof.plans.registry import query
from labelproof.plans.row_queries import PAGE_RULES_SQL, expanded_effects, page_rules
from labelproof.session import one_row, scratch_path, stored

# --- ranks -------------------------------------------------------------------


@query(
    "f1_rank_in_target",
    "WITH {manifest} SELECT item_id, target, row_number() OVER (PARTITION BY target ORDER BY item_id) - 1 AS rank FROM manifest",
)
def f1(t):
    rows = rk.value_slice(manifest(t).select("item_id", "target"), "item_id")
    return rk.numbered(rows, ["target"], ["item_id"]).withColumn("rank", F.col("rank") - 1).select("item_id", "target", "rank")


@query(
    "f2_first_n_per_group",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2",
)
def f2(t):
    return rk.top_rows(t.conversations, ["conv_id"], ["turn"], 2).select("conv_id", "turn", "role")


@query(
    "f2_first_n_per_target",
    "WITH {manifest} SELECT item_id, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY item_id) AS r FROM manifest) WHERE r <= 25",
)
def f2_target(t):
    return rk.top_rows(manifest(t).select("item_id", "target"), ["target"], ["item_id"], 25)


@query(
    "f3_group_total_on_rows",
    "WITH {docs} SELECT item_id, target, n_chars, sum(n_chars) OVER (PARTITION BY target)::BIGINT AS target_chars FROM docs",
)
def f3(t):
    rows = docs(t).select("item_id", "target", "n_chars")
    totals = rows.groupBy("target").agg(F.sum("n_chars").alias("target_chars"))
    return rk.with_group_row(rows, totals, ["target"])


@query(
    "f4_average_percent_rank",
    """WITH {manifest} SELECT item_id, value, (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM manifest""",
)
def f4(t):
    return rk.average_percent_rank(manifest(t).select("item_id", "value"), "value", "pct")


SQL_DIFFICULTY = """
pct AS (SELECT *, (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pv,
  (rank() OVER (ORDER BY actual_font_size) + (count(*) OVER (PARTITION BY actual_font_size) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pf FROM effects),
scored AS (SELECT item_id, target, (1.0::DOUBLE - pv) + (1.0::DOUBLE - pf) + abs(rotation_degrees) / greatest(max(abs(rotation_degrees)) OVER (), 1e-9::DOUBLE)
  + coalesce(blur_radius, 0) / greatest(max(coalesce(blur_radius, 0)) OVER (), 1e-9::DOUBLE) + (93 - coalesce(jpeg_quality, 93)) / 21.0::DOUBLE AS difficulty FROM pct)
"""


def difficulty(t):
    """Items with a difficulty score; the two global maxima are one aggregate row."""
    e = expanded_effects(t).select(
        "item_id", "target", "value", "actual_font_size", "rotation_degrees", "blur_radius", "jpeg_quality"
    )
    # used by two rank tables, the maxima and the final rows: parse the JSON once
    e = stored(e, "effects")
    blur = F.coalesce("blur_radius", F.lit(0.0))
    tops = one_row(e.agg(F.max(F.abs("rotation_degrees")).alias("mr"), F.max(blur).alias("mb")))
    by_value = rk.percent_rank_table(e.select("value"), "value", "pv")
    by_size = rk.percent_rank_table(e.select("actual_font_size"), "actual_font_size", "pf")
    # sizes are few, so their rows are spread; an item without value or size keeps its row with a null score
    known = rk.is_number("value", e)
    valued = e.filter(known).join(by_value, "value", "left").unionByName(e.filter(~known).withColumn("pv", F.lit(None).cast("double")))
    ranked = rk.with_group_row(valued, by_size, ["actual_font_size"], keep=True)
    tiny = F.lit(1e-9)
    score = (
        (F.lit(1.0) - F.col("pv"))
        + (F.lit(1.0) - F.col("pf"))
        + F.abs("rotation_degrees") / F.greatest(tops.getField("mr"), tiny)
        + blur / F.greatest(tops.getField("mb"), tiny)
        + (F.lit(93) - F.coalesce("jpeg_quality", F.lit(93))) / F.lit(21.0)
    )
    return ranked.select("item_id", "target", score.alias("difficulty"))


@query("f5_difficulty_score", "WITH {effects}, " + SQL_DIFFICULTY + " SELECT item_id, target, round(difficulty, 9) AS difficulty FROM scored")
def f5(t):
    return difficulty(t).withColumn("difficulty", F.round("difficulty", 9))


@query(
    "f6_hardest_per_target",
    "WITH {effects}, " + SQL_DIFFICULTY + """, top AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(difficulty, 9) DESC, item_id) AS r FROM scored)
    SELECT item_id, target, round(difficulty, 9) AS difficulty FROM top WHERE r <= 3 ORDER BY target, r""",
)
def f6(t):
    scored = f5(t)
    top = rk.top_rows(scored, ["target"], [F.desc("difficulty"), "item_id"], 3, rank="r")
    once = sp.distinct_first(top, ["item_id"], ["r"])
    return once.orderBy("target", "r").drop("r")


@query(
    "f7_representative_rows",
    """WITH {manifest}, m AS (SELECT *, median(value) OVER (PARTITION BY target, split) AS md FROM manifest),
    r AS (SELECT *, row_number() OVER (PARTITION BY target, split ORDER BY round(abs(value - md), 9), item_id) AS rn FROM m)
    SELECT target, split, item_id, value, round(md, 9) AS group_median FROM r WHERE rn = 1""",
)
def f7(t):
    rows = manifest(t).select("item_id", "target", "split", "value")
    middle = rk.exact_quantiles(rows, ["target", "split"], "value", [0.5], ["md"]).withColumn("group_median", F.round("md", 9))
    near = rk.with_group_row(rows, middle, ["target", "split"]).withColumn("gap", F.round(F.abs(F.col("value") - F.col("md")), 9))
    return rk.top_rows(near, ["target", "split"], ["gap", "item_id"], 1).select("target", "split", "item_id", "value", "group_median")


SQL_AUDITED = f"audited AS (SELECT page_id, url, regexp_extract(url, '/([a-z]{{2}})/', 1) AS target, ({PAGE_RULES_SQL}) = '' AS ok, ({PAGE_RULES_SQL}) AS reason FROM pages)"


def audited_pages(t):
    checked = rules.first_failure(t.pages, page_rules())
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1)
    return checked.select("page_id", "url", lang.alias("target"), F.col("usable").alias("ok"), "reason")


@query(
    "f8_accept_cap",
    "WITH " + SQL_AUDITED + """, c AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM audited)
    SELECT page_id, target, ok FROM c WHERE before < 5""",
)
def f8(t):
    return rk.accepted_until(audited_pages(t), "target", "page_id", "ok", 5).select("page_id", "target", "ok")


@query(
    "f9_first_accepted_wins",
    "WITH " + SQL_AUDITED + """, h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)/', 1)) AS host, ok, reason FROM audited),
    f AS (SELECT host, min(page_id) AS first_id FROM h WHERE ok GROUP BY host)
    SELECT page_id, h.host, CASE WHEN ok AND page_id <> first_id THEN 'entity already accepted' ELSE reason END AS reason, ok AND page_id = first_id AS usable
    FROM h LEFT JOIN f USING (host)""",
)
def f9(t):
    rows = audited_pages(t).withColumn("host", F.lower(F.regexp_extract("url", "^https?://([^/]+)/", 1)))
    marked = rk.first_accepted(rows, "host", "page_id", "ok")
    late = F.col("ok") & ~F.col("is_first")
    return marked.select(
        "page_id", "host", F.when(late, "entity already accepted").otherwise(F.col("reason")).alias("reason"), F.col("is_first").alias("usable")
    )


SQL_QUOTA = """ok AS (SELECT * FROM catalogue WHERE lower(usable) IN ('true','1')),
  drawn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sha256('42|' || target || '|' || entity), entity) AS r FROM ok)"""


@query(
    "f10_quota_labels",
    "WITH {catalogue}, " + SQL_QUOTA + """ SELECT entity, target, CASE WHEN r <= 12 THEN 'train' WHEN r <= 15 THEN 'validation' WHEN r <= 18 THEN 'test' ELSE 'excluded' END AS label FROM drawn""",
)
def f10(t):
    selected, excluded = quota(t)
    return selected.select("entity", "target", F.col("split").alias("label")).unionByName(
        excluded.select("entity", "target", F.lit("excluded").alias("label"))
    )


# --- sorts -------------------------------------------------------------------


@query(
    "g1_mixed_sort",
    "WITH {preds} SELECT truth, predicted, count(*)::BIGINT AS rows, max(confidence) AS top FROM preds GROUP BY 1, 2 ORDER BY rows DESC, truth, predicted",
)
def g1(t):
    cells = predictions(t).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("rows"), F.max("confidence").alias("top"))
    return cells.orderBy(F.desc("rows"), "truth", "predicted")


@query(
    "g2_domain_order",
    """WITH {manifest} SELECT target, split, count(*)::BIGINT AS items FROM manifest GROUP BY 1, 2
    ORDER BY list_position(['view','signup','purchase','error','click'], target), list_position(['train','validation','test'], split)""",
)
def g2(t):
    cells = manifest(t).groupBy("target", "split").agg(F.count(F.lit(1)).alias("items"))
    return cells.orderBy(rs.in_order("target", CLASSES[::-1]), rs.in_order("split", SPLITS))


@query("g3_case_insensitive_sort", "SELECT doc_id, text FROM documents ORDER BY lower(text), text, doc_id")
def g3(t):
    return t.documents.select("doc_id", "text").orderBy(F.lower("text"), "text", "doc_id")


@query(
    "g4_top_by_frequency",
    "WITH {manifest} SELECT item_text, count(*)::BIGINT AS items FROM manifest GROUP BY item_text ORDER BY items DESC, item_text LIMIT 15",
)
def g4(t):
    return manifest(t).groupBy("item_text").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "item_text").limit(15)


# --- sets and shapes ---------------------------------------------------------


@query(
    "h1_union",
    """WITH {preds} SELECT item_id, truth, 'validation' AS origin FROM preds WHERE split = 'validation'
    UNION ALL SELECT item_id, truth, 'test' FROM preds WHERE split = 'test'""",
)
def h1(t):
    p = predictions(t).select("item_id", "truth", "split")
    return rs.stack_frames([p.filter(F.col("split") == s).withColumnRenamed("split", "origin") for s in ("validation", "test")])


@query(
    "h2_distinct_first_kept",
    "WITH {manifest} SELECT entity, target, item_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, target ORDER BY item_id) AS r FROM manifest) WHERE r = 1",
)
def h2(t):
    return sp.distinct_first(manifest(t), ["entity", "target"], ["item_id"]).select("entity", "target", "item_id", "value")


@query(
    "h3_wide_to_long",
    """WITH {preds}, w AS (SELECT truth, count(*)::BIGINT AS items, count(*) FILTER (WHERE correct)::BIGINT AS correct_items FROM preds GROUP BY truth)
    SELECT truth, 'items' AS metric, items AS metric_value FROM w UNION ALL SELECT truth, 'correct_items', correct_items FROM w""",
)
def h3(t):
    wide = predictions(t).groupBy("truth").agg(F.count(F.lit(1)).alias("items"), F.count_if("correct").alias("correct_items"))
    return rs.melt(wide, ["truth"], ["items", "correct_items"], "metric", "metric_value")


@query(
    "h4_melt_confusion",
    """WITH {preds}, c AS (SELECT unnest(['click','error','purchase','signup','view']) AS label)
    SELECT a.label AS truth, 'predicted_' || b.label AS cell, count(p.item_id)::BIGINT AS rows FROM c a CROSS JOIN c b LEFT JOIN preds p ON p.truth = a.label AND p.predicted = b.label GROUP BY 1, 2""",
)
def h4(t):
    wide = ev.confusion_wide(predictions(t), CLASSES)
    return rs.melt(wide, ["truth"], [f"predicted_{c}" for c in CLASSES], "cell", "rows")


@query(
    "h5_pivot_zero_fill",
    "WITH {manifest} SELECT item_text, " + ", ".join(f"count(*) FILTER (WHERE target = '{c}')::BIGINT AS n_{c}" for c in CLASSES) + " FROM manifest GROUP BY item_text",
)
def h5(t):
    return rs.crosstab(manifest(t), "item_text", "target", CLASSES, prefix="n_")


@query(
    "h6_set_equality",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
    (SELECT k, 'orders' AS only_in FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) UNION ALL (SELECT k, 'customer' FROM (SELECT k FROM b EXCEPT SELECT k FROM a))""",
)
def h6(t):
    a = t.orders.select(F.col("o_custkey").alias("k"))
    b = t.customer.select(F.col("c_custkey").alias("k"))
    return rs.set_difference(a, b, "orders", "customer")


@query(
    "h6_unequal_sets",
    """WITH a AS (SELECT DISTINCT o_custkey + 5 AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
    (SELECT k, 'orders' AS only_in FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) UNION ALL (SELECT k, 'customer' FROM (SELECT k FROM b EXCEPT SELECT k FROM a))""",
)
def h6_unequal(t):
    a = t.orders.select((F.col("o_custkey") + 5).alias("k"))
    return rs.set_difference(a, t.customer.select(F.col("c_custkey").alias("k")), "orders", "customer")


# --- splits ------------------------------------------------------------------


@query(
    "i1_ratio_split",
    """WITH {catalogue}, d AS (SELECT entity, target, count(*) OVER (PARTITION BY target) AS n,
      row_number() OVER (PARTITION BY target ORDER BY sha256('42|' || target || '|' || entity), entity) AS r FROM (SELECT DISTINCT entity, target FROM catalogue)),
    q AS (SELECT *, greatest(1, round_even(n * 0.15::DOUBLE, 0)::BIGINT) AS k FROM d),
    f AS (SELECT *, CASE WHEN 2 * k >= n THEN 1 ELSE k END AS kk FROM q)
    SELECT entity, target, CASE WHEN r <= kk THEN 'test' WHEN r <= 2 * kk THEN 'validation' ELSE 'train' END AS split FROM f""",
)
def i1(t):
    return sp.ratio_split(catalogue(t), "entity", "target")


REQUIRED = ("entity", "target", "path", "source", "license")


def quota(t):
    """12/3/3 entities per market segment of the usable catalogue."""
    return sp.quota_split(catalogue(t), "entity", "target", SEGMENTS, sp.QUOTAS, 42, required=REQUIRED)


@query(
    "i2_quota_selected",
    "WITH {catalogue}, " + SQL_QUOTA + """ SELECT entity, target, CASE WHEN r <= 12 THEN 'train' WHEN r <= 15 THEN 'validation' ELSE 'test' END AS split,
    42::BIGINT AS selection_seed, entity_id, path, source, license, usable, balance FROM drawn WHERE r <= 18""",
)
def i2(t):
    selected, _ = quota(t)
    return sp.ordered_split(selected, "entity", "target", SEGMENTS)


@query(
    "i2_quota_excluded",
    "WITH {catalogue}, " + SQL_QUOTA + """ SELECT entity, target, 'not selected for balanced sample of 18 per target' AS exclusion_reason,
    42::BIGINT AS selection_seed, entity_id, path, source, license, usable, balance FROM drawn WHERE r > 18""",
)
def i2_excluded(t):
    _, excluded = quota(t)
    return excluded


@query(
    "i3_balance_check",
    "WITH {catalogue}, " + SQL_QUOTA + """, s AS (SELECT entity, target, CASE WHEN r <= 12 THEN 'train' WHEN r <= 15 THEN 'validation' ELSE 'test' END AS split FROM drawn WHERE r <= 18),
    g AS (SELECT '*' AS target, '*' AS split, count(DISTINCT entity)::BIGINT AS found FROM s
      UNION ALL SELECT target, '*', count(DISTINCT entity) FROM s GROUP BY target UNION ALL SELECT '*', split, count(DISTINCT entity) FROM s GROUP BY split
      UNION ALL SELECT target, split, count(DISTINCT entity) FROM s GROUP BY target, split),
    w AS (SELECT *, ((CASE target WHEN '*' THEN 5 ELSE 1 END) * (CASE split WHEN '*' THEN 18 WHEN 'train' THEN 12 ELSE 3 END))::BIGINT AS expected FROM g)
    SELECT target, split, expected, found, CASE WHEN expected = found THEN 'PASS' ELSE 'FAIL' END AS status FROM w""",
)
def i3(t):
    selected, _ = quota(t)
    return sp.balance_check(selected, "entity", "target", SEGMENTS, sp.QUOTAS)


@query(
    "i4_group_sample",
    "WITH {manifest} SELECT item_id, target, value FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sha256('42|' || item_id::VARCHAR), item_id) AS r FROM manifest) WHERE r <= 6",
)
def i4(t):
    return sp.group_sample(manifest(t).select("item_id", "target", "value"), ["target"], "item_id", 6)


@query(
    "i5_reproducible_run",
    "WITH {manifest} SELECT '' AS scope, '' AS key FROM manifest WHERE FALSE",
)
def i5(t):
    again = manifest(t).repartition(7, "entity")
    return sp.reproducibility(manifest(t), again, "target", "item_id", F.concat_ws("|", "item_text", "value"))


@query(
    "i5_changed_sample",
    """WITH {manifest}, s AS (SELECT item_id, row_number() OVER (PARTITION BY target ORDER BY sha256('42|' || item_id::VARCHAR), item_id) AS r FROM manifest)
    SELECT 'table' AS scope, '' AS key UNION ALL SELECT 'item', item_id::VARCHAR FROM s WHERE r <= 6 AND item_id % 3 = 0""",
)
def i5_changed_sample(t):
    changed = manifest(t).withColumn("item_text", F.when(F.col("item_id") % 3 == 0, "other").otherwise(F.col("item_text")))
    return sp.reproducibility(manifest(t), changed, "target", "item_id", F.concat_ws("|", "item_text", "value"))


@query(
    "i5_changed_run",
    """WITH {manifest} SELECT item_id, CASE WHEN item_id % 11 = 4 THEN 'removed' ELSE 'changed' END AS change FROM manifest
    WHERE item_id % 11 = 4 OR (item_id % 3 = 0 AND item_text <> 'other') OR (item_id % 13 = 5 AND value IS NOT NULL)
    UNION ALL SELECT -1 - item_id, 'added' FROM manifest WHERE item_id % 17 = 2""",
)
def i5_changed(t):
    """Every key in which the second run differs: edited text, edited values, rows lost and new."""
    path = scratch_path(t.spark, "run")
    first = manifest(t)
    digests.record(first, ["item_id"], path)
    i = F.col("item_id")
    edited = first.withColumn("item_text", F.when(i % 3 == 0, "other").otherwise(F.col("item_text"))).withColumn(
        "value", F.when(i % 13 == 5, -F.col("value") - 1).otherwise(F.col("value"))
    )
    new = first.filter(i % 17 == 2).withColumn("item_id", -1 - i)
    return digests.changed_keys(edited.filter(i % 11 != 4).unionByName(new), ["item_id"], path)


@query(
    "i5_null_shift",
    "SELECT count(*)::BIGINT AS rows, count(*) = 0 AS same_fingerprint FROM documents",
)
def i5_null_shift(t):
    """Values moved from one column to another that was null: another table, though the values are the same."""
    none = F.lit(None).cast("string")
    before = t.documents.select(F.col("lang").alias("a"), none.alias("b"))
    after = t.documents.select(none.alias("a"), F.col("lang").alias("b"))
    left, right = sp.fingerprint(before), one_row(sp.fingerprint(after))
    return left.select("rows", (F.col("fingerprint") == right.getField("fingerprint")).alias("same_fingerprint"))


# Texts of the item grid of this binding.
GRID_TEXTS = tuple(f"text {i:02d}" for i in range(12))

SQL_GRID = """ranked AS (SELECT entity, target, row_number() OVER (PARTITION BY target ORDER BY sha256('42|' || entity), entity) - 1 AS rank FROM catalogue),
  texts AS (SELECT r.rank, x.v AS item_text, row_number() OVER (PARTITION BY r.rank ORDER BY sha256('42|' || r.rank::VARCHAR || '|' || x.v), x.v) - 1 AS item_index
    FROM (SELECT DISTINCT rank FROM ranked) r, (SELECT 'text ' || lpad(i::VARCHAR, 2, '0') AS v FROM range(12) tt(i)) x),
  grid AS (SELECT entity, target, rank, item_index, 42 * 2000003 + rank * 10007 + item_index AS item_seed, item_text FROM ranked JOIN texts USING (rank) WHERE item_index < 8)"""


def grid(t):
    """Eight items per catalogue entity; entities are ranked inside their target by hash draw."""
    rows = catalogue(t).select("entity", "target").withColumn("draw", rk.hash_draw(42, "entity"))
    ranked = rk.numbered(rows.withColumn(rk.SLICE, rk.draw_slice(F.col("draw"))), ["target"], ["draw", "entity"])
    ranked = ranked.select("entity", "target", (F.col("rank") - 1).alias("rank"))
    return sp.item_grid(ranked, "rank", 8, GRID_TEXTS)


@query("i6_item_grid", "WITH {catalogue}, " + SQL_GRID + " SELECT entity, target, rank, item_index, item_seed, item_text FROM grid")
def i6(t):
    return grid(t).select("entity", "target", "rank", F.col("item_index").cast("bigint").alias("item_index"), "item_seed", "item_text")


def _unit(field: str) -> str:
    block, place = divmod(sp.PLAN_DRAWS.index(field), 8)
    return f"('0x' || substr(d{block}, {8 * place + 1}, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


def _whole(field: str, low, high) -> str:
    return f"({low} + floor({_unit(field)} * ({high} - {low} + 1)))::BIGINT"


def _real(field: str, low: float, high: float, digits: int) -> str:
    return f"round({low}::DOUBLE + {_unit(field)} * {high - low!r}::DOUBLE, {digits})"


_LOW = "CASE WHEN dark AND soft THEN 170 WHEN dark THEN 220 WHEN soft THEN 70 ELSE 0 END"
_HIGH = "CASE WHEN dark AND soft THEN 210 WHEN dark THEN 255 WHEN soft THEN 110 ELSE 55 END"
_GROUND = [_whole(f"background{i}", "(CASE WHEN dark THEN 5 ELSE 232 END)", "(CASE WHEN dark THEN 45 ELSE 255 END)") for i in range(3)]
_FRONT = [_whole(f"foreground{i}", f"({_LOW})", f"({_HIGH})") for i in range(3)]
SQL_PLAN = f"""digests AS (SELECT *, sha256(item_seed || '|0') AS d0, sha256(item_seed || '|1') AS d1, sha256(item_seed || '|2') AS d2 FROM grid),
  flags AS (SELECT *, {_unit('dark')} < 0.28::DOUBLE AS dark, {_unit('soft')} < 0.35::DOUBLE AS soft FROM digests),
  colours AS (SELECT *, [{', '.join(_GROUND)}] AS g, [{', '.join(_FRONT)}] AS f FROM flags)
  SELECT entity, target, item_index, item_seed, CASE WHEN dark THEN 'dark' ELSE 'light' END AS background, array_to_string(g, ',') AS background_rgb,
    CASE WHEN soft THEN 'soft' ELSE 'strong' END AS contrast_style, array_to_string(f, ',') AS foreground_rgb,
    round(abs(list_sum(g) - list_sum(f))::DOUBLE / 3.0::DOUBLE, 2) AS luminance_difference, {_whole('letter_spacing', 0, 3)} AS letter_spacing_px,
    {_whole('font_size', 27, 62)} AS requested_font_size, {_whole('horizontal', -12, 12)} AS horizontal_shift_px, {_whole('vertical', -4, 4)} AS vertical_shift_px,
    {_real('scale', 0.94, 1.06, 4)} AS scale_factor, {_real('rotation', -2.5, 2.5, 3)} AS rotation_degrees,
    CASE WHEN {_unit('blur')} < 0.22::DOUBLE THEN {_real('blur_radius', 0.1, 0.55, 3)} END AS blur_radius,
    CASE WHEN {_unit('jpeg')} < 0.28::DOUBLE THEN {_whole('jpeg_quality', 72, 92)} END AS jpeg_quality FROM colours"""


@query("i7_augmentation_plan", "WITH {catalogue}, " + SQL_GRID + ", " + SQL_PLAN)
def i7(t):
    planned = sp.augmentation_plan(grid(t), "item_seed")
    flat = planned.select("entity", "target", F.col("item_index").cast("bigint").alias("item_index"), "item_seed", "effects.*")
    return flat.withColumns({c: F.array_join(c, ",") for c in ("background_rgb", "foreground_rgb")})


@query(
    "i7_plan_ignores_target",
    "WITH {catalogue}, " + SQL_GRID + " SELECT count(DISTINCT item_seed)::BIGINT AS seeds, count(DISTINCT item_seed)::BIGINT AS plans, count(*)::BIGINT AS items FROM grid",
)
def i7_shared(t):
    """Distinct seeds equal distinct (seed, plan) pairs: a plan depends on the seed alone."""
    planned = sp.augmentation_plan(grid(t), "item_seed").select("item_seed", F.to_json("effects").alias("plan"))
    pairs = planned.groupBy("item_seed", "plan").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.countDistinct("item_seed").alias("seeds"), F.count(F.lit(1)).alias("plans"), F.sum("n").alias("items")
    )
