"""The registered queries of the corpus operators and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.llm import (
    bpe,
    decontam,
    fingerprint,
    hpy_lm,
    importance,
    langid,
    line_dedup,
    line_quality,
    ngram_join,
    pii,
    secret_scan,
    spelling,
    warc,
)
from labelproof.llm.folds import fold
from labelproof.schemas import Tables
from labelproof.session import scratch_path, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


VOCABULARY = corpus_pipeline.VOCABULARY


@query("op1_byte_level_bpe")
def op1_byte_level_bpe(t: Tables) -> DataFrame:
    encoder = bpe.BytePairEncoder(bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.round_trip(t.documents, ["doc_id"], "text", encoder).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS s
  FROM words, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT y, root FROM reach JOIN both_ways ON x = node WHERE root < y)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2_ngram_jaccard_join(t: Tables) -> DataFrame:
    return ngram_join.linked(t.documents, "doc_id", "text")


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, octet_length(encode(coalesce(html, ''))) AS n,
    sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(first, page_id) AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""


@query("op3_warc", OP3_SQL)
def op3_warc(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "warc")
    warc.write(t.pages, "page_id", "url", "html", folder)
    carried = F.col("kind") == "response"
    return warc.records(warc.read(t.spark, folder)).select(
        F.col("page").cast("long").alias("page_id"),
        F.when(carried, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(carried, F.sha2("payload", 256)).otherwise(F.col("stated_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def listed(spans, kinds: tuple[str, ...]):
    """Spans as kind:start:end, comma-joined, by start and then kind as listed."""
    places = F.array(*map(F.lit, kinds))
    keyed = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("a"), F.array_position(places, s["kind"]).alias("k"), s["end"].alias("b")),
    )
    named = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", F.get(places, s["k"].cast("int") - 1), s["a"], s["b"]))
    return F.array_join(named, ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op4_secret_scan")
def op4_secret_scan(t: Tables) -> DataFrame:
    found = secret_scan.spans(t.documents, "doc_id", "text")
    return found.select(
        "doc_id",
        *(counted("base", kind).alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]),
        F.sha2(listed("base", secret_scan.KINDS), 256).alias("base_sha256"),
        listed(F.concat("base", "added"), secret_scan.KINDS).alias("spans"),
    )


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size,
    array_to_string(list_slice(words, i, i + least(13, len(words)) - 1), ' ') AS gram
  FROM items, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS u(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS gram
  FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS u(i)),
found AS (SELECT g.doc_id, g.i, g.size, w.item_id FROM grams g JOIN windows w ON g.size = w.size AND g.gram = w.gram),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5_benchmark_decontamination(t: Tables) -> DataFrame:
    judged = decontam.report(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda i: i.cast("string"))))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


@query("op6_language_id")
def op6_language_id(t: Tables) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(t.documents, "doc_id", "text", "lang", ~held_out)
    found = langid.predictions(t.documents, ["doc_id"], "text", model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_pii")
def op7_pii(t: Tables) -> DataFrame:
    model = pii.fit(t.documents, "doc_id", "text")
    found = pii.spans(t.documents, ["doc_id"], "text", model)
    return found.select(
        "doc_id",
        *(counted("base", kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(listed("base", pii.KINDS), 256).alias("base_sha256"),
        listed(F.concat("base", "added"), pii.KINDS).alias("spans"),
    )


@query("op8_line_dedup")
def op8_line_dedup(t: Tables) -> DataFrame:
    return line_dedup.deduplicated(t.documents, "doc_id", "text").select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2("text", 256).alias("kept_sha256"),
        F.char_length("text").cast("long").alias("kept_chars"),
    )


@query("op9_lm_scoring")
def op9_lm_scoring(t: Tables) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    model = hpy_lm.fit(t.documents, "doc_id", "text", ~held_out)
    return hpy_lm.scores(t.documents, "doc_id", "text", model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.setting.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query("op10_fingerprints")
def op10_fingerprints(t: Tables) -> DataFrame:
    return fingerprint.edited_and_next(t.documents, "doc_id", "text")


@query("op11_quality_classifier")
def op11_quality_classifier(t: Tables) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    field = line_quality.fit(t.documents, t.labels, "doc_id", "text", "quality", ~held_out)
    return line_quality.scores(spread(t.documents), ["doc_id"], "text", field).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


# DuckDB has no crc32: the sum is made of one entry of a table per byte, by the byte's distance from the end. The tables
# follow from the polynomial; texts(s) are the strings to hash and crc(s, h) their unsigned checksums.
CRC_SQL = r"""
longest AS (SELECT max(octet_length(encode(s))) AS n FROM texts),
first_table AS (
  SELECT b, list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) AS t(b)),
tables AS (
  SELECT CAST(0 AS BIGINT) AS back, b, v FROM first_table
  UNION ALL
  SELECT p.back + 1, p.b, xor(p.v // 256, z.v) FROM tables p JOIN first_table z ON z.b = p.v % 256
  WHERE p.back < (SELECT n FROM longest)),
plain AS (SELECT s, octet_length(encode(s)) AS n, hex(encode(s)) AS h FROM texts),
bytes AS (
  SELECT s, n - i AS back, CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) AS b
  FROM plain, unnest(range(1, n + 1)) AS u(i)),
-- the sum starts from all bits set, which turns over the first four bytes
crc AS (
  SELECT s, xor(bit_xor(v), 4294967295) AS h FROM (
    SELECT s, t.v FROM bytes x JOIN plain USING (s) JOIN tables t
      ON t.back = x.back AND t.b = CASE WHEN n - x.back <= 4 THEN 255 - x.b ELSE x.b END
    UNION ALL
    SELECT s, 4294967295 // (1 << CAST(8 * n AS INTEGER)) FROM plain WHERE n < 4) GROUP BY s)
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS k FROM runs GROUP BY ALL),
texts AS (SELECT s FROM counted),
{CRC_SQL.strip()},
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word, k FROM counted JOIN crc USING (s)),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.cut = b.word),
near AS (
  SELECT p.word, count(*) AS n_near, max(w.n) AS most,
    first(p.other ORDER BY w.n DESC, encode(p.other)) AS best
  FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN best END AS form,
    CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM words w LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS place FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.place WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.place AS root FROM chain c JOIN forms f ON f.word = c.place WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN ends USING (word)
"""


@query("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(t: Tables) -> DataFrame:
    return spelling.variants(spelling.counted_words(spread(t.documents), "doc_id", "text"))


OP13_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_runs AS (
  SELECT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM docs, unnest([1, 2, 3]) AS v(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
item_runs AS (
  SELECT array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM items, unnest([1, 2, 3]) AS v(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
texts AS (SELECT s FROM doc_runs UNION SELECT s FROM item_runs),
{CRC_SQL.strip()},
doc_counts AS (SELECT h % 10000 AS bucket, count(*) AS n FROM doc_runs JOIN crc USING (s) GROUP BY 1),
item_counts AS (SELECT h % 10000 AS bucket, count(*) AS n FROM item_runs JOIN crc USING (s) GROUP BY 1),
gains AS (
  SELECT u.bucket, CAST(floor(1000 * ln((coalesce(i.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM doc_counts) + 10000)::DOUBLE
    / ((coalesce(d.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM item_counts) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) AS u(bucket) LEFT JOIN doc_counts d USING (bucket) LEFT JOIN item_counts i USING (bucket)),
weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain) AS weight
  FROM doc_runs JOIN crc USING (s) JOIN gains ON gains.bucket = h % 10000 GROUP BY doc_id),
scores AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, len(w) >= 20 AS enough
  FROM docs LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place FROM scores)
SELECT doc_id, n_features, weight, score,
  CASE WHEN enough AND place <= (SELECT count(*) FROM scores WHERE enough) * 5 // 100 THEN place END AS rank
FROM placed
"""


@query("op13_importance_resampling", OP13_SQL)
def op13_importance_resampling(t: Tables) -> DataFrame:
    return importance.resampled(spread(t.documents), t.benchmark, "doc_id", "text", "text")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
