"""Content hashing and near-duplicate queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.functions import vectors as vx
from labelproof.operators import dedup
from labelproof.plans.registry import query

SQL_PROFILE = r"""
words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents),
cnt AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 257 AS b, count(*)::BIGINT AS c FROM words WHERE w <> '' GROUP BY 1, 2),
dense AS (SELECT d.doc_id, g.i, coalesce(c, 0) AS c FROM documents d CROSS JOIN (SELECT i FROM range(257) t(i)) g LEFT JOIN cnt ON cnt.doc_id = d.doc_id AND cnt.b = g.i),
bits AS (SELECT doc_id, i - 1 AS i, CASE WHEN c >= lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS bit FROM dense),
halves AS (SELECT doc_id, i // 32 AS h, sum(bit::BIGINT << (31 - i % 32)::INT)::BIGINT AS v FROM bits WHERE i >= 0 GROUP BY 1, 2)
"""

SQL_WIDE = ", hashes AS (SELECT doc_id, " + ", ".join(f"max(v) FILTER (WHERE h = {i}) AS h{i}" for i in range(8)) + " FROM halves GROUP BY doc_id)"
SQL_DISTANCE = " + ".join(f"bit_count(xor(a.h{i}, b.h{i}))::BIGINT" for i in range(8))


def _links_sql(distance: int) -> str:
    return (
        "WITH "
        + SQL_PROFILE
        + SQL_WIDE
        + f""",
    grp AS (SELECT sha256(text) AS digest, min(doc_id) AS keep FROM documents GROUP BY 1),
    copies AS (SELECT keep AS left_id, doc_id AS right_id FROM documents JOIN grp ON grp.digest = sha256(text) WHERE doc_id <> keep),
    prof AS (SELECT k.keep AS doc_id, coalesce((SELECT string_agg(b || ':' || c, ',' ORDER BY b) FROM cnt WHERE cnt.doc_id = k.keep), '') AS p FROM grp k),
    pg AS (SELECT p, min(doc_id) AS keep FROM prof GROUP BY p),
    same AS (SELECT keep AS left_id, doc_id AS right_id FROM prof JOIN pg USING (p) WHERE doc_id <> keep),
    reps AS (SELECT hashes.* FROM hashes JOIN pg ON pg.keep = hashes.doc_id),
    cand AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, ({SQL_DISTANCE})::BIGINT AS distance FROM reps a JOIN reps b ON a.doc_id < b.doc_id WHERE ({SQL_DISTANCE}) <= {distance}),
    norms AS (SELECT doc_id, sum(c * c)::BIGINT AS n FROM cnt GROUP BY 1),
    dots AS (SELECT left_id, right_id, distance, sum(x.c * y.c)::BIGINT AS d FROM cand JOIN cnt x ON x.doc_id = left_id JOIN cnt y ON y.doc_id = right_id AND y.b = x.b GROUP BY 1, 2, 3),
    near AS (SELECT left_id, right_id, distance, d::DOUBLE / sqrt(l.n::DOUBLE * r.n::DOUBLE) AS similarity FROM dots JOIN norms l ON l.doc_id = left_id JOIN norms r ON r.doc_id = right_id)
    SELECT left_id, right_id, 'copy' AS kind, 0::BIGINT AS distance, 1.0::DOUBLE AS similarity FROM copies
    UNION ALL SELECT left_id, right_id, 'same_profile', 0, 1.0::DOUBLE FROM same
    UNION ALL SELECT left_id, right_id, 'near', distance, similarity FROM near WHERE similarity >= 0.995"""
    )


@query(
    "c11_difference_hash",
    "WITH " + SQL_PROFILE + SQL_WIDE + " SELECT doc_id, " + " || ".join(f"printf('%08x', h{i})" for i in range(8)) + " AS hash FROM hashes",
)
def c11(t):
    hashed = dedup.text_profiles(t.documents, "doc_id", "text")
    return hashed.select("doc_id", vx.hash_hex(F.col("bands"), 4).alias("hash"))


@query(
    "c11_difference_hash_vectors",
    "WITH h AS (SELECT vec_id, "
    + ", ".join(
        "(" + " + ".join(f"(CASE WHEN embedding[{i + 2}] >= embedding[{i + 1}] THEN {1 << (min(s + 16, 63) - 1 - i)} ELSE 0 END)" for i in range(s, min(s + 16, 63))) + f")::BIGINT AS q{s // 16}"
        for s in (0, 16, 32, 48)
    )
    + " FROM embeddings) SELECT vec_id, printf('%04x', q0) || printf('%04x', q1) || printf('%04x', q2) || printf('%04x', q3) AS hash FROM h",
)
def c11_vectors(t):
    bands = vx.difference_hash(F.col("embedding"), 63, 16)
    rows = t.embeddings.select("vec_id", bands.alias("b"))
    return rows.select("vec_id", F.concat(*[F.lpad(F.lower(F.hex(F.element_at("b", i))), 4, "0") for i in (1, 2, 3, 4)]).alias("hash"))


@query(
    "c12_hamming_distance",
    "WITH " + SQL_PROFILE + SQL_WIDE + f" SELECT a.doc_id, ({SQL_DISTANCE})::BIGINT AS distance FROM hashes a JOIN hashes b ON b.doc_id = a.doc_id + 1",
)
def c12(t):
    hashed = dedup.text_profiles(t.documents, "doc_id", "text").select("doc_id", "bands")
    following = hashed.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bands").alias("next_bands"))
    return hashed.join(following, "doc_id").select("doc_id", vx.hamming(F.col("bands"), F.col("next_bands")).alias("distance"))


@query("d6_suspicious_links_2_bits", _links_sql(2))
def d6(t):
    return dedup.suspicious_links(t.documents, "doc_id", "text", max_distance=2, width=64)


@query("d6_suspicious_links_8_bits", _links_sql(8))
def d6_wide(t):
    return dedup.suspicious_links(t.documents, "doc_id", "text", max_distance=8, width=16)
