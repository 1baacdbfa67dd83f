"""Language identification by compression: the dictionary that shortens a text most names its language.

For every language a few zstandard raw-content dictionaries are filled with excerpts of labelled texts. A text is
compressed with one dictionary of each language and takes the language of the smallest result. Where the two smallest
results are within ``close`` of each other, the other dictionaries are tried too and the sizes added up; where they
are still within ``reject`` the text is marked as rejected.

Only the fit reads labels. It takes a bounded sample: at most ``sample_rows`` rows per language, those of the
smallest hashed id, ``excerpt_chars`` of each, and ``rounds`` dictionaries of ``dictionary_bytes``. These bounds limit
what is sent to the executors; every text is compressed whole, in pieces of ``PIECE`` bytes.

Defined cases: texts that are null or hold no letter get ``und``, score 0 and are rejected. Without labelled rows all
texts do. With a single language every text with a letter gets it. Equal sizes go to the first name in order. Repeated
rows are judged alike. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.batches import bounded, tidy

UNKNOWN = "und"
PIECE = 8192
# zstandard stores a block as it is unless that gains some bytes; with this before them, short texts show their gain too
FILLER = bytes(256)
# ASCII letters in lower case; other ASCII characters but blanks say nothing about the language and are left out
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
LEFT_OUT = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122 or b in (9, 10, 11, 12, 13, 32)))


def letters_only(text: bytes) -> bytes:
    return text.translate(LOWER, LEFT_OUT)


def has_letter(text: bytes) -> bool:
    kept = text.translate(LOWER, LEFT_OUT + b" \t\n\v\f\r")
    return kept[:1].isalpha() or kept.isascii() and bool(kept) or any(map(str.isalpha, text.decode()))


class LanguageModel:
    """Dictionaries by language, all languages having the same number of them."""

    def __init__(self, dictionaries: dict[str, list[bytes]], close: float = 0.06, reject: float = 0.002):
        self.dictionaries = dictionaries
        self.names = sorted(dictionaries)
        self.close = close
        self.reject = reject
        self._compressors: dict[tuple[str, int], zstandard.ZstdCompressor] = {}

    def __getstate__(self):
        return {**self.__dict__, "_compressors": {}}

    def _compressor(self, name: str, round_: int) -> zstandard.ZstdCompressor:
        if (name, round_) not in self._compressors:
            settings = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_LAZY,
                min_match=3,
                search_log=4,
                hash_log=17,
                chain_log=18,
                window_log=19,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            content = zstandard.ZstdCompressionDict(
                self.dictionaries[name][round_], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(compression_params=settings)
            self._compressors[name, round_] = zstandard.ZstdCompressor(compression_params=settings, dict_data=content)
        return self._compressors[name, round_]

    def forget(self) -> None:
        """Lets the compressors go; they are made anew when they are needed."""
        self._compressors.clear()

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not text or not self.names or not has_letter(text):
            return UNKNOWN, 0.0, True
        data = letters_only(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        if len(data) < len(FILLER):
            pieces = [FILLER + b" " + data + b" "]
        sizes = dict.fromkeys(self.names, 0)
        rounds = len(self.dictionaries[self.names[0]])
        for round_ in range(rounds):
            for name in self.names:
                compress = self._compressor(name, round_).compress
                sizes[name] += sum(len(compress(p)) for p in pieces)
            order = sorted(self.names, key=lambda n: (sizes[n], n))
            best = sizes[order[0]]
            margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
            if margin >= self.close:
                break
        # a byte less doubles the odds
        score = 1.0 / sum(2.0 ** -min(60, (size - best) / (round_ + 1)) for size in sizes.values())
        return order[0], score, margin < self.reject


def fit(
    docs: DataFrame,
    key: str,
    text: str,
    language: str,
    training: Column,
    dictionary_bytes: int = 1 << 17,
    rounds: int = 4,
    sample_rows: int = 1200,
    excerpt_chars: int = 2000,
) -> LanguageModel:
    """Dictionaries from the rows where ``training`` holds and the language is known."""
    labelled = docs.filter(training & F.col(language).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy("language").orderBy("draw", "id")
    drawn = labelled.select(F.col(language).alias("language"), F.col(key).alias("id"), F.xxhash64(key).alias("draw"))
    counts = {r.language: r["count"] for r in drawn.groupBy("language").count().collect()}
    # rows of a frequent language are thinned by their hashed id before they meet in one task; a language's share is
    # large enough to leave sample_rows of it
    share = F.lit(1.0)
    for name, count in counts.items():
        share = F.when(F.col("language") == name, min(1.0, (1.5 * sample_rows + 100) / count)).otherwise(share)
    ids = (
        drawn.filter(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30))
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= sample_rows)
        .select("id")
        .collect()
    )
    chosen = labelled.filter(F.col(key).isin([r.id for r in ids])) if ids else labelled.limit(0)
    excerpts = chosen.select(
        F.col(language).alias("language"),
        F.xxhash64(key).alias("draw"),
        F.expr(f"substring(`{text}`, 1, {int(excerpt_chars)})").alias("excerpt"),
    ).collect()
    by_language: dict[str, list[bytes]] = {}
    for row in sorted(excerpts, key=lambda r: (r.language, r.draw, r.excerpt)):
        by_language.setdefault(row.language, []).append(letters_only(row.excerpt.encode()) + b"\n")
    dictionaries = {}
    for name, parts in by_language.items():
        dictionaries[name] = []
        for round_ in range(rounds):
            # each dictionary gets every rounds-th excerpt, so few excerpts are shared out evenly
            content = b"".join(parts[round_::rounds] or parts)[:dictionary_bytes]
            dictionaries[name].append(content.ljust(8, b"\n"))
    return LanguageModel(dictionaries)


RESULT = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]


def predictions(docs: DataFrame, keys: list[str], text: str, model: LanguageModel) -> DataFrame:
    """(keys, lang_pred, score, rejected) per row."""
    rows = docs.select(F.col(text).alias("__text"), *keys)

    def judged(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            columns = [
                pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *columns], [*keys, "lang_pred", "score", "rejected"]
            )

    return bounded(rows).mapInArrow(tidy(judged, model.forget), T.StructType([*(docs.schema[k] for k in keys), *RESULT]))


def known_language(docs: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    place, names = docs.columns.index(text), docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def kept(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not model.predict(t)[2] for t in texts], pa.bool_()))

    return bounded(rows).mapInArrow(tidy(kept, model.forget), rows.schema).toDF(*names)
