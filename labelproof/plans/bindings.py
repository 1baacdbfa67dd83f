"""Bind the roles of the operators (key, entity, target, split, ...) to the input tables.

Each binding has the same derivation written for Spark and as SQL text; the SQL
is the reference side of the correctness check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.operators.ranking import draw_number, hash_draw
from labelproof.schemas import Tables

CLASSES = ("click", "error", "purchase", "signup", "view")
SPLITS = ("train", "validation", "test")
# chosen so that every split holds entities even in the smallest input folder
SPLIT_SEED = 59
LANGUAGES = ("de", "en", "es", "fr")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def split_label(seed: int, key: str) -> Column:
    """70 / 15 / 15 split label drawn from a hash of the key."""
    draw = draw_number(hash_draw(seed, key)) % 100
    return F.when(draw < 70, "train").when(draw < 85, "validation").otherwise("test")


def _sql_split(seed: int, key: str) -> str:
    draw = f"('0x' || substr(sha256('{seed}|' || {key}::VARCHAR), 1, 8))::BIGINT % 100"
    return f"CASE WHEN {draw} < 70 THEN 'train' WHEN {draw} < 85 THEN 'validation' ELSE 'test' END"


def manifest(t: Tables) -> DataFrame:
    """Events as an item manifest: one row per item, entity = user, target = event type."""
    number = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("target"),
        split_label(SPLIT_SEED, "user_id").alias("split"),
        F.col("props").alias("item_text"),
        number.alias("k"),
        "ts",
        "value",
    )


def leaky_manifest(t: Tables) -> DataFrame:
    """The same manifest with the split drawn per item, so entities leak."""
    return manifest(t).withColumn("split", split_label(43, "item_id"))


SQL_MANIFEST = f"""
manifest AS (
  SELECT event_id AS item_id, user_id AS entity, event_type AS target,
         {_sql_split(SPLIT_SEED, 'user_id')} AS split, props AS item_text,
         (props::JSON ->> '$.k')::BIGINT AS k, ts, value
  FROM events
)
"""
SQL_LEAKY = f"""
leaky AS (
  SELECT event_id AS item_id, user_id AS entity, event_type AS target,
         {_sql_split(43, 'event_id')} AS split, props AS item_text, ts, value
  FROM events
)
"""


def predictions(t: Tables) -> DataFrame:
    """Five-class predictions over the events; right more often when confident."""
    r = F.col("item_id") % 100
    gap = (F.lit(99) - r) * (F.lit(99) - r) * 69
    percent = F.lit(99) - F.floor(gap / F.lit(9801.0))
    base = manifest(t).select("item_id", "entity", F.col("target").alias("truth"), "split", "k", "ts", F.col("value").alias("inference_ms"))
    names = F.array(*[F.lit(c) for c in CLASSES])
    guess = F.element_at(names, (F.col("k") % 5 + 1).cast("int"))
    scored = base.withColumn("percent", percent.cast("bigint")).withColumn(
        "predicted", F.when(F.col("k") < F.col("percent"), F.col("truth")).otherwise(guess)
    )
    confidence = F.col("percent") / F.lit(100.0)
    rest = (F.lit(1.0) - F.col("confidence")) / F.lit(4.0)
    return (
        scored.withColumn("confidence", confidence)
        .withColumn("correct", F.col("truth") == F.col("predicted"))
        .withColumn(
            "probabilities",
            F.array(*[F.when(F.col("predicted") == c, F.col("confidence")).otherwise(rest) for c in CLASSES]),
        )
    )


SQL_PREDS = (
    SQL_MANIFEST.strip()
    + """,
preds0 AS (
  SELECT item_id, entity, target AS truth, split, k, ts, value AS inference_ms,
         99 - ((99 - item_id % 100) * (99 - item_id % 100) * 69) // 9801 AS percent
  FROM manifest
),
preds AS (
  SELECT item_id, entity, truth, split, k, ts, inference_ms, percent,
         CASE WHEN k < percent THEN truth ELSE (['click','error','purchase','signup','view'])[(k % 5 + 1)::INT] END AS predicted,
         percent::DOUBLE / 100.0::DOUBLE AS confidence,
         truth = (CASE WHEN k < percent THEN truth ELSE (['click','error','purchase','signup','view'])[(k % 5 + 1)::INT] END) AS correct,
         (1.0::DOUBLE - percent::DOUBLE / 100.0::DOUBLE) / 4.0::DOUBLE AS rest
  FROM preds0
)
"""
)


def effects(t: Tables) -> DataFrame:
    """The manifest with an effect plan per item, as a JSON text column ``effects_json``."""
    k = F.col("k")
    fields = [
        (F.lit(27) + k % 36).cast("bigint").alias("actual_font_size"),
        F.when(k % 4 == 0, "dark").otherwise("light").alias("background"),
        F.when(k % 5 == 0, (k % 45 + 10) / F.lit(100.0)).alias("blur_radius"),
        F.when(k % 3 == 0, "soft").otherwise("strong").alias("contrast_style"),
        (k % 25 - 12).alias("horizontal_shift_px"),
        F.when(k % 7 < 2, F.lit(72) + k % 21).cast("bigint").alias("jpeg_quality"),
        (k % 4).alias("letter_spacing_px"),
        (F.lit(100) + k).cast("double").alias("luminance_difference"),
        ((k - 50) / F.lit(20.0)).alias("rotation_degrees"),
        (F.lit(1.0) + (k % 13 - 6) / F.lit(100.0)).alias("scale_factor"),
        (k % 9 - 4).alias("vertical_shift_px"),
    ]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return manifest(t).withColumn("effects_json", text)


SQL_EFFECTS = (
    SQL_MANIFEST.strip()
    + """,
effects AS (
  SELECT item_id, entity, target, split, item_text, k, value,
         27 + k % 36 AS actual_font_size,
         CASE WHEN k % 4 = 0 THEN 'dark' ELSE 'light' END AS background,
         CASE WHEN k % 5 = 0 THEN (k % 45 + 10)::DOUBLE / 100.0::DOUBLE END AS blur_radius,
         CASE WHEN k % 3 = 0 THEN 'soft' ELSE 'strong' END AS contrast_style,
         k % 25 - 12 AS horizontal_shift_px,
         CASE WHEN k % 7 < 2 THEN 72 + k % 21 END AS jpeg_quality,
         k % 4 AS letter_spacing_px,
         (100 + k)::DOUBLE AS luminance_difference,
         (k - 50)::DOUBLE / 20.0::DOUBLE AS rotation_degrees,
         1.0::DOUBLE + (k % 13 - 6)::DOUBLE / 100.0::DOUBLE AS scale_factor,
         k % 9 - 4 AS vertical_shift_px
  FROM manifest
)
"""
)

EPOCHS_PER_RUN = 15


def history(t: Tables) -> DataFrame:
    """Training history: consecutive events form runs of 15 epochs; the score is the event value."""
    n = EPOCHS_PER_RUN
    return t.events.select(
        F.floor(F.col("event_id") / n).cast("bigint").alias("run"),
        (F.col("event_id") % n + 1).alias("epoch"),
        (F.col("value") / F.lit(1000.0)).alias("validation_macro_f1"),
        (F.col("user_id") % 100 / F.lit(100.0)).alias("validation_accuracy"),
    )


SQL_HISTORY = f"""
history AS (
  SELECT event_id // {EPOCHS_PER_RUN} AS run, event_id % {EPOCHS_PER_RUN} + 1 AS epoch,
         value / 1000.0::DOUBLE AS validation_macro_f1,
         (user_id % 100)::DOUBLE / 100.0::DOUBLE AS validation_accuracy
  FROM events
)
"""


def docs(t: Tables) -> DataFrame:
    """Documents as a text manifest: entity = source, target = language."""
    return t.documents.select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("entity"),
        F.col("lang").alias("target"),
        split_label(SPLIT_SEED, "source").alias("split"),
        "text",
        "n_chars",
    )


SQL_DOCS = f"""
docs AS (
  SELECT doc_id AS item_id, source AS entity, lang AS target,
         {_sql_split(SPLIT_SEED, 'source')} AS split, text, n_chars
  FROM documents
)
"""


def catalogue(t: Tables) -> DataFrame:
    """Customers as an entity catalogue: one entity per row, target = market segment."""
    return t.customer.select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_name").alias("entity"),
        F.col("c_mktsegment").alias("target"),
        F.concat(F.lit("data/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string")).alias("path"),
        F.lit("catalogue").alias("source"),
        F.when(F.col("c_nationkey") % 2 == 0, "OFL").otherwise("APACHE2").alias("license"),
        F.when(F.col("c_acctbal") >= 0, F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("1"))
        .otherwise("False")
        .alias("usable"),
        F.col("c_acctbal").alias("balance"),
    )


SQL_CATALOGUE = """
catalogue AS (
  SELECT c_custkey AS entity_id, c_name AS entity, c_mktsegment AS target,
         'data/' || lower(c_mktsegment) || '/' || c_custkey::VARCHAR AS path, 'catalogue' AS source,
         CASE WHEN c_nationkey % 2 = 0 THEN 'OFL' ELSE 'APACHE2' END AS license,
         CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE '1' END ELSE 'False' END AS usable,
         c_acctbal AS balance
  FROM customer
)
"""

SQL_VIEWS = {
    "manifest": SQL_MANIFEST,
    "leaky": SQL_LEAKY,
    "preds": SQL_PREDS,
    "effects": SQL_EFFECTS,
    "history": SQL_HISTORY,
    "docs": SQL_DOCS,
    "catalogue": SQL_CATALOGUE,
}
