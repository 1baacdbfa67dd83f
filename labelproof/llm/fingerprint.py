"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame operations only.

Every paragraph (line) is hashed to one wide vector; a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane, modulo powers of two. So the order of paragraphs does not matter, and inserting or deleting a paragraph
adds or subtracts its vector (``inserted``, ``deleted``) without reading the rest of the document.

A vector has two parts.
* 8 identity lanes modulo 2^32, hashed from the whole paragraph: equal fingerprints mean equal multisets of paragraphs.
* 124 sketch lanes modulo 2^24. Each word pair of the paragraph adds a random sign to every lane, so the cosine of two
  sketches estimates the cosine of the documents' word-pair counts, with a standard error of about 0.09.

Defined cases: a null text counts as the empty text, which is one empty paragraph. Rows that repeat an id are
fingerprinted one by one. An empty table gives an empty table. Only the named columns are read and returned, so extra
columns cannot clash. Texts of any length are whole: words stream through the sums, which hold 71 numbers per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.session import shuffle_width

IDENTITY_LANES = 8
IDENTITY_MODULUS = 1 << 32
SHIFTS = 31
SKETCH_LANES = 4 * SHIFTS
SKETCH_MODULUS = 1 << 24
# two counters of 31 bits in one long: a text may hold 2^31 word pairs
_TWO_BITS = 1 | (1 << SHIFTS)
_LOW = (1 << SHIFTS) - 1
SPACES = "[\\x20\\x09-\\x0D]+"


def _vector_sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per ``keys`` with ``identity`` and ``sketch`` (arrays of bigint): the sums over its text's paragraphs."""
    paragraphs = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("__p"))
    # the lambda variable holds the words, so that they are split once per paragraph
    pairs = F.flatten(
        F.transform(
            F.array(F.split("__p", SPACES)),
            lambda words: F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))),
        )
    )
    elements = paragraphs.select(
        *keys,
        F.xxhash64("__p").alias("__p1"),
        F.xxhash64(F.lit("second"), "__p").alias("__p2"),
        F.posexplode(pairs).alias("__i", "__h"),
    ).withColumn("__g", F.xxhash64(F.lit(7), "__h"))
    sums = [
        F.sum(
            F.when(
                F.col("__i") == 0,
                F.xxhash64("__p1", "__p2", F.lit(lane)).bitwiseAND(F.lit(IDENTITY_MODULUS - 1)),
            )
        ).alias(f"__id{lane}")
        for lane in range(IDENTITY_LANES)
    ]
    for name in ("h", "g"):
        sums += [
            F.sum(F.shiftright(f"__{name}", shift).bitwiseAND(F.lit(_TWO_BITS))).alias(f"__{name}{shift}")
            for shift in range(SHIFTS)
        ]
    summed = elements.groupBy(*keys).agg(F.count("__h").alias("__n"), *sums)
    # a lane's sum of signs: every pair adds +1 where its bit is set, else -1
    counts = []
    for name in ("h", "g"):
        for shift in range(SHIFTS):
            packed = F.col(f"__{name}{shift}")
            counts += [packed.bitwiseAND(F.lit(_LOW)), F.shiftright(packed, SHIFTS)]
    identity = F.array(*(F.col(f"__id{lane}").bitwiseAND(F.lit(IDENTITY_MODULUS - 1)) for lane in range(IDENTITY_LANES)))
    sketch = F.array(*((F.lit(2) * c - F.col("__n")).bitwiseAND(F.lit(SKETCH_MODULUS - 1)) for c in counts))
    return summed.select(*keys, identity.alias("identity"), sketch.alias("sketch"))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, identity, sketch) of every row; ``key`` must tell the rows apart."""
    return _vector_sums(docs.select(F.col(key), F.col(text)), [key], text)


def _lanewise(a: Column, b: Column, modulus: int, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(modulus - 1)))


def inserted(identity: Column, sketch: Column, more_identity: Column, more_sketch: Column) -> tuple[Column, Column]:
    """Fingerprint after the paragraphs behind ``more_*`` were added."""
    return _lanewise(identity, more_identity, IDENTITY_MODULUS, 1), _lanewise(sketch, more_sketch, SKETCH_MODULUS, 1)


def deleted(identity: Column, sketch: Column, less_identity: Column, less_sketch: Column) -> tuple[Column, Column]:
    """Fingerprint after the paragraphs behind ``less_*`` were taken out."""
    return _lanewise(identity, less_identity, IDENTITY_MODULUS, -1), _lanewise(sketch, less_sketch, SKETCH_MODULUS, -1)


def as_text(identity: Column, sketch: Column) -> Column:
    """The fingerprint as lowercase hex, 8 digits per identity lane and 6 per sketch lane."""
    wide = F.array_join(F.transform(identity, lambda x: F.lpad(F.hex(x), 8, "0")), "")
    narrow = F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 6, "0")), "")
    return F.lower(F.concat(wide, narrow))


def _signed(sketch: Column) -> Column:
    half = SKETCH_MODULUS // 2
    return F.transform(sketch, lambda x: (F.when(x >= half, x - SKETCH_MODULUS).otherwise(x)).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated cosine of two documents' word-pair counts from their signed sketches, 0 to 1; 1 where ``same``."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    cosine = F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def id_bounds(docs: DataFrame, key: str, parts: int) -> list:
    """At most ``parts`` values of ``key`` that cut the rows, in its order, into slices of about equal size."""
    shares = [i / parts for i in range(1, parts)]
    row = docs.agg(F.percentile_approx(key, shares, 10 * parts).alias("cuts")).first()
    return sorted(set(row.cuts or []))


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in order of (key, text), cut into slices: (__slice, __place, __guest, __key, __text, __next).

    The order is cut at key quantiles, so no task sorts the whole table. Each slice also gets the first row of the
    slice after it as a guest, and the last slice the first row of all. Null keys come first.
    """
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    cuts = id_bounds(docs, key, 2 * shuffle_width(docs.sparkSession))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    place = F.size(F.filter(bounds, lambda b: b <= F.col("__key"))) if cuts else F.lit(0)
    sliced = rows.withColumn("__slice", F.when(F.col("__key").isNull(), F.lit(0)).otherwise(place))
    firsts = {r["__slice"]: r["__first"] for r in sliced.groupBy("__slice").agg(_first_key().alias("__first")).collect()}
    used = sorted(firsts)
    rows = sliced.withColumn("__guest", F.lit(False))
    if used:
        # one more scan for all guests: the keys are constants, pushed down to the files
        of = F.create_map(*[x for h, a in zip(used, used[1:] + used[:1], strict=True) for x in (F.lit(a), F.lit(h))])
        wanted = [firsts[s]["k"] for s in used]
        chosen = F.col("__key").isin([k for k in wanted if k is not None])
        if None in wanted:
            chosen = chosen | F.col("__key").isNull()
        borrowed = sliced.filter(chosen).withColumn("__slice", of[F.col("__slice")]).withColumn("__guest", F.lit(True))
        rows = rows.unionByName(borrowed)
    order = Window.partitionBy("__slice").orderBy("__guest", F.col("__key").asc_nulls_first(), "__text")
    return rows.withColumn("__place", F.row_number().over(order)).withColumn("__next", F.lead("__text").over(order))


def _first_key() -> Column:
    return F.min(F.struct(F.col("__key").isNotNull().alias("known"), F.col("__key").alias("k")))


def edited_and_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, the fingerprints of the text and its edited text, and two likenesses.

    The edited text has its last quarter replaced by as many first code points of the next row's text.
    """
    rows = followed(docs, key, text).withColumn(
        "edited",
        F.concat(
            F.expr("substring(__text, 1, char_length(__text) - char_length(__text) div 4)"),
            F.coalesce(F.expr("substring(__next, 1, cast(char_length(__text) div 4 as int))"), F.lit("")),
        ),
    )
    # renaming the slice column would hide the partitioning from the planner
    keys = ["__slice", "__place", "__guest", "__key", "n_chars", "edited_sha256", "side"]
    sides = rows.select(
        *keys[:4],
        F.char_length("__text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("__text", "edited")).alias("side", "side_text"),
    )
    # all of this happens inside the slices: the window's partitioning serves the sums and the next window
    vectors = _vector_sums(sides, keys, "side_text")
    order = Window.partitionBy("__slice").orderBy("__place", "side")
    both = vectors.select(
        *keys,
        "identity",
        "sketch",
        *(F.lead(c, 1).over(order).alias(f"edited_{c}") for c in ("identity", "sketch")),
        *(F.lead(c, 2).over(order).alias(f"next_{c}") for c in ("identity", "sketch")),
    ).filter("side = 0 AND NOT __guest")
    return both.select(
        F.col("__key").alias(key),
        "n_chars",
        "edited_sha256",
        as_text(F.col("identity"), F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_identity"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(
            _signed(F.col("sketch")), _signed(F.col("edited_sketch")), F.col("identity") == F.col("edited_identity")
        ).alias("near_edited"),
        likeness(
            _signed(F.col("sketch")), _signed(F.col("next_sketch")), F.col("identity") == F.col("next_identity")
        ).alias("near_next"),
    )
