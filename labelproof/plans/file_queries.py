"""File sources and sinks, and image queries. Files are written from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions.images import cell_histograms, gradient_features, image_similarity, normalised
from labelproof.operators import admission, dedup, gates, profile, rules
from labelproof.plans import gallery
from labelproof.plans.bindings import LANGUAGES, manifest
from labelproof.plans.registry import query
from labelproof.schemas import schema
from labelproof.session import scratch_path, spread, stored
from labelproof.sources import files, sinks

CSV_SCHEMA = schema("c_custkey:long c_name:str note:str c_acctbal:dbl c_mktsegment:str")


def customers_csv(t):
    path = scratch_path(t.spark, "csv")
    r = F.col("c_custkey") % 3
    note = F.when(r == 0, "").when(r == 1, F.lit(None)).otherwise(F.concat(F.lit('said "a, b"\n'), F.col("c_name")))
    sinks.write_csv(t.customer.select("c_custkey", "c_name", note.alias("note"), "c_acctbal", "c_mktsegment"), path)
    return path


SQL_NOTE = "CASE WHEN c_custkey % 3 = 2 THEN 'said \"a, b\"' || chr(10) || c_name ELSE {empty} END AS note"


@query("a1_csv_scan_keep_empty", "SELECT c_custkey, c_name, " + SQL_NOTE.format(empty="''") + ", c_acctbal, c_mktsegment FROM customer")
def a1_keep(t):
    return files.read_csv(t.spark, customers_csv(t), CSV_SCHEMA, keep_empty=True)


@query("a1_csv_scan_null_empty", "SELECT c_custkey, c_name, " + SQL_NOTE.format(empty="NULL") + ", c_acctbal, c_mktsegment FROM customer")
def a1_null(t):
    return files.read_csv(t.spark, customers_csv(t), CSV_SCHEMA)


REPORT_ROW = T.StructType([T.StructField("rows", T.ArrayType(schema("target:str items:long entities:long")))])
SQL_TARGETS = "SELECT event_type AS target, count(*)::BIGINT AS items, count(DISTINCT user_id)::BIGINT AS entities FROM events GROUP BY event_type"


def target_counts(t):
    return profile.counts_with_entities(manifest(t), ["target"], "entity")


@query("a4_json_document_scan", SQL_TARGETS)
def a4(t):
    path = scratch_path(t.spark, "json")
    sinks.write_json_report(target_counts(t), path)
    return files.read_json(t.spark, path, REPORT_ROW).select(F.inline("rows"))


@query(
    "a5_catalogue_scan",
    """SELECT lang AS target, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS position, lang || '-' || source AS name
    FROM (SELECT DISTINCT lang, source FROM documents)""",
)
def a5(t):
    path = scratch_path(t.spark, "catalogue")
    names = t.documents.select("lang", F.concat_ws("-", "lang", "source").alias("name")).distinct()
    # a catalogue is a configuration document: a few names per target
    lists = names.groupBy("lang").agg(F.array_sort(F.collect_list(F.concat(F.lit(" "), F.upper("name")))).alias("names"))
    entry = F.struct("lang", "names")
    document = lists.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    document.coalesce(1).write.text(path)
    return files.read_catalogue(t.spark, path, LANGUAGES).withColumn("position", F.col("position").cast("bigint"))


@query("a6_image_scan", "WITH " + gallery.SQL_GALLERY + """ SELECT vec_id, NOT missing AS exists, NOT missing AND NOT damaged AS opens_successfully,
    CASE WHEN missing THEN 'missing file' WHEN damaged THEN 'unreadable file' ELSE '' END AS error,
    CASE WHEN NOT missing AND NOT damaged THEN 32 END AS width, CASE WHEN NOT missing AND NOT damaged THEN 32 END AS height FROM gallery""")
def a6(t):
    return gallery.measured(t).select("vec_id", "exists", "opens_successfully", "error", "width", "height")


@query("a7_file_digest")
def a7(t):
    return files.read_binary(t.spark, gallery.folder(t)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query("a7_text_file_digest", "SELECT 'p' || page_id || '.html' AS name, octet_length(encode(html))::BIGINT AS length, sha256(html) AS sha256 FROM pages")
def a7_texts(t):
    path = scratch_path(t.spark, "pages")
    named = t.pages.select(F.format_string("p%d.html", "page_id").alias("name"), F.col("html").cast("binary").alias("content"))
    sinks.write_files(spread(named), path, "name", "content").write.format("noop").mode("overwrite").save()
    return files.read_binary(t.spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query("a8_whole_text_scan", "SELECT page_id, sha256(lower(html)) AS digest, length(html)::BIGINT AS characters FROM pages")
def a8(t):
    path = scratch_path(t.spark, "texts")
    named = t.pages.select(F.format_string("p%d.html", "page_id").alias("name"), F.col("html").cast("binary").alias("content"))
    sinks.write_files(spread(named), path, "name", "content").write.format("noop").mode("overwrite").save()
    texts = files.read_texts(t.spark, path)
    key = F.regexp_extract("path", r"p(\d+)\.html$", 1).cast("bigint")
    return texts.select(key.alias("page_id"), F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("characters"))


@query("a10_csv_sink", "SELECT c_mktsegment, count(*)::BIGINT AS rows, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY c_mktsegment")
def a10(t):
    back = files.read_csv(t.spark, customers_csv(t), CSV_SCHEMA)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys"))


@query("a11_json_report", "SELECT count(*)::BIGINT AS targets, sum(items)::BIGINT AS items FROM (" + SQL_TARGETS + ")")
def a11(t):
    path = scratch_path(t.spark, "report")
    sinks.write_json_report(target_counts(t), path, "targets")
    shape = T.StructType([T.StructField("targets", REPORT_ROW["rows"].dataType)])
    rows = files.read_json(t.spark, path, shape).select(F.inline("targets"))
    return rows.agg(F.count(F.lit(1)).alias("targets"), F.sum("items").alias("items"))


@query(
    "a12_partitioned_layout",
    "WITH {manifest} SELECT target, count(*)::BIGINT AS items, sum(item_id)::BIGINT AS keys FROM manifest WHERE split = 'validation' GROUP BY target",
)
def a12(t):
    path = scratch_path(t.spark, "layout")
    sinks.write_partitioned(manifest(t).select("item_id", "entity", "target", "split"), path, ["split", "target"])
    shape = schema("item_id:long entity:long split:str target:str")
    # the split filter prunes folders
    kept = t.spark.read.schema(shape).parquet(path).filter("split = 'validation'")
    return kept.groupBy("target").agg(F.count(F.lit(1)).alias("items"), F.sum("item_id").alias("keys"))


@query("a13_write_once", "SELECT *, TRUE AS second_write_refused FROM (" + SQL_TARGETS + ")")
def a13(t):
    path = scratch_path(t.spark, "once")
    result = target_counts(t)
    sinks.write_once(result, path)
    try:
        sinks.write_once(result, path)
        refused = False
    except FileExistsError:
        refused = True
    return t.spark.read.schema(result.schema).json(path).withColumn("second_write_refused", F.lit(refused))


@query(
    "a14_markdown_table",
    """WITH x AS (SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS target, count(*) AS pages, replace(replace(min(url) || '|' || chr(10) || 'end', '|', '/'), chr(10), ' ') AS u FROM pages GROUP BY 1)
    SELECT '| target | pages | first |' AS value UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || target || ' | ' || pages || ' | ' || u || ' |' FROM x""",
)
def a14(t):
    """A report of a few rows, one per target, which is what one Markdown file is for."""
    path = scratch_path(t.spark, "markdown")
    per = t.pages.groupBy(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("target"))
    rows = per.agg(F.count(F.lit(1)).alias("pages"), F.concat(F.min("url"), F.lit("|\nend")).alias("first"))
    sinks.write_markdown(rows, path, ["target"])
    return t.spark.read.text(path)


# --- images ------------------------------------------------------------------


@query(
    "b8_quality_flag_counts",
    "WITH " + gallery.SQL_GALLERY + """ SELECT count(*)::BIGINT AS items, count(*) FILTER (WHERE NOT missing AND NOT damaged)::BIGINT AS opened,
    count(*) FILTER (WHERE missing)::BIGINT AS missing, count(*) FILTER (WHERE damaged)::BIGINT AS corrupt, count(*) FILTER (WHERE blank)::BIGINT AS blank,
    count(*) FILTER (WHERE NOT missing AND NOT damaged AND ((SELECT stddev_pop(x) FROM (SELECT unnest(levels) AS x)) < 5 OR list_max(levels) - list_min(levels) < 10))::BIGINT AS low_pixel_contrast,
    0::BIGINT AS wrong_size FROM gallery""",
)
def b8(t):
    return rules.quality_counts(rules.quality_flags(gallery.measured(t), 32, 32))


@query(
    "b9_admission",
    "WITH " + gallery.SQL_GALLERY + """ SELECT vec_id, CASE WHEN damaged THEN 'unsupported type' WHEN blank THEN 'blank or nearly blank' ELSE '' END AS reason,
    NOT damaged AND NOT blank AS admitted FROM gallery WHERE NOT missing""",
)
def b9(t):
    judged = admission.admit_folder(t.spark, gallery.folder(t))
    return judged.select(gallery.key_of().alias("vec_id"), "reason", "admitted")


SQL_AWKWARD = """SELECT vec_id, CASE r WHEN 3 THEN 'too many bytes' WHEN 4 THEN 'unsupported type' WHEN 5 THEN 'blank or nearly blank' WHEN 6 THEN 'too many pixels'
      WHEN 7 THEN 'unreadable' WHEN 9 THEN 'too small' ELSE '' END AS reason, r NOT IN (3, 4, 5, 6, 7, 9) AS admitted,
    CASE WHEN r = 6 THEN 6000 WHEN r = 9 THEN 16 WHEN r IN (3, 4, 7) THEN NULL ELSE 32 END AS width,
    CASE WHEN r = 6 THEN 5001 WHEN r = 9 THEN 12 WHEN r IN (3, 4, 7) THEN NULL ELSE 24 END AS height
    FROM (SELECT vec_id, vec_id % 25 AS r FROM embeddings)"""


@query("b9_admission_by_header", SQL_AWKWARD)
def b9_by_header(t):
    """Too many bytes or pixels are told without reading or decoding; sizes are those of the turned picture."""
    folder = gallery.awkward_folder(t)
    judged = admission.admit_folder(t.spark, folder, max_bytes=gallery.AWKWARD_BYTES, max_pixels=gallery.AWKWARD_PIXELS)
    return judged.select(gallery.key_of().alias("vec_id"), "reason", "admitted", "width", "height")


@query(
    "c17_turned_pictures",
    "WITH " + gallery.SQL_GALLERY + """, seen AS (SELECT vec_id, list_transform(levels[:48], lambda v: (v / 255.0::DOUBLE - 0.5) / 0.5) AS x FROM gallery WHERE vec_id % 25 NOT IN (3, 4, 6, 7, 9))
    SELECT vec_id, 32 AS width, 24 AS height, round(x[1], 5) AS top_left, round(x[8], 5) AS top_right, round(x[41], 5) AS bottom_left, round(x[48], 5) AS bottom_right,
    round(list_avg(x), 4) AS mean FROM seen""",
)
def c17_turned(t):
    """Copies stored in all eight orientations give the pixels of the upright picture."""
    kind = gallery.key_of() % 25
    images = files.read_images(t.spark, gallery.awkward_folder(t)).filter(F.col("decoded") & ~kind.isin(3, 9))
    rows = normalised(images, "path", 32, 24, keep=("width", "height"))
    corner = {"top_left": 0, "top_right": 31, "bottom_left": 23 * 32, "bottom_right": 24 * 32 - 1}
    return rows.select(
        gallery.key_of().alias("vec_id"),
        "width",
        "height",
        *[F.round(F.get("tensor", i).cast("double"), 5).alias(n) for n, i in corner.items()],
        F.round(F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x.cast("double")) / 768, 4).alias("mean"),
    )


@query(
    "c16_pixel_statistics",
    "WITH " + gallery.SQL_GALLERY + """, px AS (SELECT vec_id, unnest(levels)::DOUBLE AS x FROM gallery WHERE NOT missing AND NOT damaged),
    tiled AS (SELECT vec_id, x FROM px, range(16))
    SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS minimum, max(x) AS maximum, max(x) - min(x) AS intensity_range,
    round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.99), 6) AS p99 FROM tiled GROUP BY vec_id""",
)
def c16(t):
    rows = gallery.measured(t).filter("opens_successfully")
    return rows.select(
        "vec_id",
        *[F.round(c, 6).alias(c) for c in ("mean", "std")],
        "minimum",
        "maximum",
        "intensity_range",
        *[F.round(c, 6).alias(c) for c in ("p01", "p99")],
    )


@query(
    "c17_normalised_pixels",
    "WITH " + gallery.SQL_GALLERY + """ SELECT 'v' || vec_id || '.png' AS name, 1024 AS values, round((list_min(levels) / 255.0::DOUBLE - 0.5) / 0.5, 5) AS lowest,
    round((list_max(levels) / 255.0::DOUBLE - 0.5) / 0.5, 5) AS highest, round(16 * list_sum(list_transform(levels, lambda x: (x / 255.0::DOUBLE - 0.5) / 0.5)), 2) AS total
    FROM gallery WHERE NOT missing AND NOT damaged""",
)
def c17(t):
    """At the pictures' own size every value is its level, scaled."""
    rows = normalised(files.read_images(t.spark, gallery.folder(t)), "path", 32, 32)
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.size("tensor").alias("values"),
        F.round(F.array_min("tensor").cast("double"), 5).alias("lowest"),
        F.round(F.array_max("tensor").cast("double"), 5).alias("highest"),
        F.round(F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"),
    )


@query("c17_stretched_pixels")
def c17_stretched(t):
    """A smaller size, so that the pictures are resized."""
    rows = normalised(files.read_images(t.spark, gallery.folder(t)), "path", 16, 24)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return rows.select(name, F.size("tensor").alias("values"), F.array_min("tensor").alias("lowest"), F.array_max("tensor").alias("highest"))


@query(
    "k3_cell_histograms",
    "WITH " + gallery.SQL_GALLERY + """, px AS (SELECT vec_id, y, x, levels[(y // 4) * 8 + x // 4 + 1] AS v FROM gallery, (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x) WHERE NOT missing AND NOT damaged),
    g AS (SELECT vec_id, y, x,
      coalesce(lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS gx,
      coalesce(lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) - lag(v) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS gy FROM px),
    a AS (SELECT vec_id, (y // 8) * 4 + x // 8 AS cell, floor(256 * sqrt((gx * gx + gy * gy)::DOUBLE))::BIGINT AS strength, degrees(atan2(gy::DOUBLE, gx::DOUBLE)) AS d FROM g WHERE gx <> 0 OR gy <> 0)
    SELECT vec_id, cell, (floor((CASE WHEN d < 0 THEN d + 180 ELSE d END) / 20.0::DOUBLE)::BIGINT % 9)::BIGINT AS bin, sum(strength)::BIGINT AS strength FROM a GROUP BY ALL""",
)
def k3_cells(t):
    """What the gradient features are made of, exactly, at the pictures' own size."""
    rows = cell_histograms(files.read_images(t.spark, gallery.folder(t)), ["path"])
    each = rows.select(gallery.key_of().alias("vec_id"), F.posexplode("counts").alias("i", "strength")).filter("strength > 0")
    place = F.col("i").cast("bigint")
    return each.select("vec_id", F.floor(place / 9).alias("cell"), (place % 9).alias("bin"), "strength")


@query("k3_gradient_features")
def k3(t):
    images = files.read_images(t.spark, gallery.folder(t))
    rows = gradient_features(images, ["path"], 224, 96)
    energy = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.size("features").alias("values"), energy.alias("energy"))


@query("d6_suspicious_images")
def d6_images(t):
    """Copies by digest, then similar pictures among different contents, verified by structural similarity."""
    # decoded and hashed once; read again by the copy links, the candidates and both sides of the check
    images = stored(gallery.hashed(t), "hashed")
    copies, groups = dedup.copy_links(images.select("path", "sha256"), "path", "sha256")
    kept = images.join(groups.select(F.col("keep").alias("path")), "path", "left_semi")
    found = dedup.hash_candidates(kept, "path", max_distance=2, width=64)
    picture = F.struct("pixels", "height", "width", "channels")
    left = kept.select(F.col("path").alias("left_id"), picture.alias("left"))
    right = kept.select(F.col("path").alias("right_id"), picture.alias("right"))
    scored = found.join(left, "left_id").join(right, "right_id").withColumn("similarity", image_similarity("left", "right"))
    near = scored.filter("similarity >= 0.995").select("left_id", "right_id", F.lit("near").alias("kind"), "distance", "similarity")
    exact = copies.select(
        "left_id", "right_id", F.lit("copy").alias("kind"), F.lit(0).cast("bigint").alias("distance"), F.lit(1.0).alias("similarity")
    )
    return exact.unionByName(near)


@query(
    "j4_file_gate",
    "WITH " + gallery.SQL_GALLERY + """, n AS (SELECT count(*) FILTER (WHERE missing) AS m, count(*) FILTER (WHERE damaged) AS d, count(*) FILTER (WHERE blank) AS b FROM gallery),
    r AS (SELECT 'files exist' AS check_name, m AS v FROM n UNION ALL SELECT 'files inside the folder', 0 FROM n UNION ALL SELECT 'files not empty', 0 FROM n
      UNION ALL SELECT 'files open', d FROM n UNION ALL SELECT 'declared size', 0 FROM n UNION ALL SELECT 'images not blank', b FROM n UNION ALL SELECT 'no unlisted file', 0 FROM n)
    SELECT check_name, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, v::VARCHAR AS evidence, CASE WHEN v = 0 THEN '' ELSE 'fix the file set' END AS required_action FROM r""",
)
def j4(t):
    rows = stored(gallery.measured(t), "measured")
    base = gallery.folder(t)
    images = rows.filter("exists").select("path", "decoded", "width", "height", "intensity_range")
    found = stored(files.list_files(t.spark, base), "listing")
    return gates.file_gate(gallery.listed(t), images, found, base.replace("file:///", "file:/"))
