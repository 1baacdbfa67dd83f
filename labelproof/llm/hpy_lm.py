"""Language model scores from a hierarchical Pitman-Yor process, its seatings sampled by Gibbs.

The next word is drawn from the restaurant of the word before it; all these restaurants share one parent, the root,
whose base is uniform over the training words and one unknown word. Words are dealt to ``RESTAURANTS`` restaurants by
the hash of the word before; words that meet in one, frequent or rare, share it, more of them the larger the
vocabulary. So what the tasks need to know of all restaurants is a vector of fixed size, which is all that is ever
broadcast.

A word's customers and tables in all restaurants, and its customers and tables in the root, lie together in the bucket
of that word. In a sweep each bucket seats every word's customers anew, one after another as in the Chinese restaurant
process, given the numbers of the sweep before: the tables of each restaurant, and the word's probability in the root.
The buckets' table counts are added up to the numbers for the next sweep. Sweeps depend on counts, those numbers and
seeds alone, so a bucket repeats the earlier ones instead of storing their seatings, and a lost executor changes
nothing. After ``burn_in`` sweeps the predictive probabilities of ``samples`` sweeps are averaged.

Texts are scored where the words are: scan tasks send the words, contexts and document numbers of a chunk of texts,
sorted and packed, to the words' buckets, which send back one sum per document. A bucket with many tokens (a word that
makes up a large part of the corpus) is scored in several parts, each with the bucket's counts.

Discounts come from the counts of counts (n1 / (n1 + 2 n2)); strengths are parameters.

Defined cases: a null text is the empty text, which has one token, its end. Without training rows every token is
unknown. Repeated rows are scored and counted one by one. A null training flag counts as false. Other columns are not
read. An empty table gives no rows. Words are told apart by 64 hashed bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelproof.llm.batches import bounded
from labelproof.llm.packing import from_planes, packed, planes, range_edges, unpacked
from labelproof.session import stored

RESTAURANTS = 1 << 16
END = 0x5851F42D4C957F2D
START = 0x14057B7EF767814F
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CACHED_WORDS = 200_000
CHUNK = 1_200_000  # tokens that a scan task gathers before it sends them
BUCKET = 1_200_000  # tokens of a bucket or of a part of one, about
ONE_BY_ONE = 64  # customers seated one by one; after them the waiting time for the next table is drawn
UNIT = 1e-9  # of the sums of the base score
COUNTS, TOKENS, DIRECTORY = range(3)

PARCEL = "bucket int, chunk bigint, kind int, words binary, sizes binary, contexts binary, numbers binary"
ARROW_PARCEL = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32())]
    + [(n, pa.binary()) for n in ("words", "sizes", "contexts", "numbers")]
)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def token_hashes(text: bytes | None, hashes: dict) -> np.ndarray:
    """Hashes of the words of a text and of its end."""
    words = text.translate(LOWER).split() if text else []
    ids = np.empty(len(words) + 1, np.uint64)
    ids[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    ids[-1] = END
    return ids


def contexts_of(tokens: np.ndarray) -> np.ndarray:
    """The restaurant of each token: the high bits of the hash of the token before it."""
    before = np.empty_like(tokens)
    before[0] = START
    before[1:] = tokens[:-1]
    return (before >> np.uint64(48)).astype(np.uint16)


def _batch(rows, schema=ARROW_PARCEL) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _count_parcels(words: np.ndarray, contexts: np.ndarray, buckets: int, chunk: int):
    """Numbers of (word, context) of a chunk, by bucket of the word."""
    names, own = np.unique(words, return_inverse=True)
    keys, numbers = np.unique((own.astype(np.uint64) << np.uint64(16)) | contexts, return_counts=True)
    own = (keys >> np.uint64(16)).astype(np.int64)
    contexts = (keys & np.uint64(0xFFFF)).astype(np.uint16)
    cuts = [0, *np.searchsorted(names, range_edges(buckets)).tolist(), len(names)]
    for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            x, y = np.searchsorted(own, [a, b])
            sizes = np.bincount(own[x:y] - a, minlength=b - a).astype(np.uint32)
            yield (
                bucket, chunk, COUNTS, packed(names[a:b]), planes(sizes),
                planes(contexts[x:y]), planes(numbers[x:y].astype(np.uint32)),
            )


def _token_parcels(words: np.ndarray, contexts: np.ndarray, documents: np.ndarray, buckets: int, chunk: int):
    """Contexts and documents of the tokens of a chunk, sorted by word, by bucket of the word."""
    order = np.argsort(words, kind="stable")
    words, contexts, documents = words[order], contexts[order], documents[order]
    starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    names, ends = words[starts], np.append(starts, len(words))
    cuts = [0, *np.searchsorted(names, range_edges(buckets)).tolist(), len(names)]
    for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            x, y = ends[a], ends[b]
            yield (
                bucket, chunk, TOKENS, packed(names[a:b]), planes(np.diff(ends[a : b + 1]).astype(np.uint32)),
                planes(contexts[x:y]), planes(documents[x:y]),
            )


def _chunks(batches):
    """(keys, tokens by text, training flags) of runs of rows with about CHUNK tokens."""
    hashes = _WordHashes()
    keys, tokens, flags, total = [], [], [], 0
    for batch in batches:
        values = batch.column(1).cast(pa.binary()).to_pylist()
        at = 0
        for i, value in enumerate(values):
            tokens.append(token_hashes(value, hashes))
            total += len(tokens[-1])
            if total >= CHUNK or i == len(values) - 1:
                keys.append(batch.column(0).slice(at, i + 1 - at))
                flags += batch.column(2).slice(at, i + 1 - at).to_pylist()
                at = i + 1
            if total >= CHUNK:
                yield keys, tokens, flags
                keys, tokens, flags, total = [], [], [], 0
    if tokens:
        yield keys, tokens, flags


def _sent_counts(batches, buckets: int):
    task = TaskContext.get().partitionId()
    for number, (_, tokens, flags) in enumerate(_chunks(batches)):
        taken = [t for t, f in zip(tokens, flags) if f]
        if taken:
            contexts = np.concatenate([contexts_of(t) for t in taken])
            yield _batch(list(_count_parcels(np.concatenate(taken), contexts, buckets, (task << 24) + number)))


def _sent_tokens(batches, buckets: int):
    task = TaskContext.get().partitionId()
    for number, (keys, tokens, _) in enumerate(_chunks(batches)):
        chunk = (task << 24) + number
        sizes = np.array([len(t) for t in tokens], np.uint32)
        names = pa.RecordBatch.from_arrays([pa.concat_arrays(keys)], ["key"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, names.schema) as writer:
            writer.write_batch(names)
        directory = (chunk % buckets, chunk, DIRECTORY, sink.getvalue().to_pybytes(), planes(sizes), None, None)
        documents = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        contexts = np.concatenate([contexts_of(t) for t in tokens])
        yield _batch([directory, *_token_parcels(np.concatenate(tokens), contexts, documents, buckets, chunk)])


COUNTED = "bucket int, words binary, sizes binary, contexts binary, numbers binary, n_words bigint, n_tokens bigint, ones bigint, twos bigint, shared_ones bigint, shared_twos bigint"
ARROW_COUNTED = pa.schema(
    [("bucket", pa.int32())]
    + [(n, pa.binary()) for n in ("words", "sizes", "contexts", "numbers")]
    + [(n, pa.int64()) for n in ("n_words", "n_tokens", "ones", "twos", "shared_ones", "shared_twos")]
)


def _counted(table: pa.Table) -> pa.Table:
    """The counts of one bucket, added up over the chunks."""
    rows = table.to_pylist()
    words = np.concatenate([np.repeat(unpacked(r["words"]), from_planes(r["sizes"], np.uint32)) for r in rows])
    contexts = np.concatenate([from_planes(r["contexts"], np.uint16) for r in rows])
    numbers = np.concatenate([from_planes(r["numbers"], np.uint32) for r in rows])
    names, own = np.unique(words, return_inverse=True)
    keys, where = np.unique((own.astype(np.uint64) << np.uint64(16)) | contexts, return_inverse=True)
    totals = np.bincount(where, numbers).astype(np.int64)
    sizes = np.bincount((keys >> np.uint64(16)).astype(np.int64), minlength=len(names))
    row = (
        rows[0]["bucket"], packed(names), planes(sizes.astype(np.uint32)),
        planes((keys & np.uint64(0xFFFF)).astype(np.uint16)), planes(totals),
        len(names), int(totals.sum()), int((totals == 1).sum()), int((totals == 2).sum()),
        int((sizes == 1).sum()), int((sizes == 2).sum()),
    )
    return pa.Table.from_batches([_batch([row], ARROW_COUNTED)])


def seated(customers: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each entry's customers one after another.

    A customer who finds i others at t tables opens a new one with probability rate / (rate + i - discount * t).
    """
    order = np.argsort(-customers, kind="stable")
    count, rate = customers[order], rate[order]
    tables = np.ones(len(count))
    active = int(np.searchsorted(-count, -2, side="right"))  # entries of 2 customers or more
    for present in range(1, ONE_BY_ONE):
        active = int(np.searchsorted(-count[:active], -(present + 1), side="right"))
        if not active:
            break
        weight = present - discount * tables[:active]
        tables[:active] += rng.random(active) * (rate[:active] + weight) < rate[:active]
    # beyond, the chance of no new table from i to j others is about ((i + x) / (j + x)) ** rate, x = rate - discount * t
    at = np.full(active, float(ONE_BY_ONE))
    index = np.arange(active)
    while len(index):
        shift = rate[index] - discount * tables[index]
        waits = -np.log(rng.random(len(index))) / np.maximum(rate[index], 1e-300)
        at[index] = (at[index] + shift) * np.exp(np.minimum(waits, 700.0)) - shift + 1
        index = index[at[index] <= count[index]]
        tables[index] += 1
    out = np.empty(len(tables))
    out[order] = tables
    return out


@dataclass
class Totals:
    """What a sweep leaves for the next: tables per restaurant, customers and tables of the root."""

    tables: np.ndarray
    root_customers: float
    root_tables: float


@dataclass
class Setting:
    vocabulary: int
    tokens: int
    discount: float
    root_discount: float
    strength: float
    root_strength: float
    customers: np.ndarray  # per restaurant
    seed: int

    def root_new(self, totals: Totals) -> float:
        """The root's weight of a word it has not seen."""
        return (self.root_strength + self.root_discount * totals.root_tables) / (self.vocabulary + 1)

    def root_probability(self, totals: Totals, customers, tables):
        weight = customers - self.root_discount * tables + self.root_new(totals)
        return weight / (self.root_strength + totals.root_customers)


class Bucket:
    """Counts of the words of one bucket, and the sweeps over them."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.words = unpacked(row["words"])
        sizes = from_planes(row["sizes"], np.uint32)
        self.word = np.repeat(np.arange(len(sizes)), sizes)
        self.context = from_planes(row["contexts"], np.uint16)
        self.count = from_planes(row["numbers"], np.int64)
        self.sizes = sizes
        self.word_count = np.bincount(self.word, self.count, len(sizes))

    def sweeps(self, setting: Setting, history: list[Totals]):
        """(tables per entry, root customers, root tables per word) after each sweep; history[0] is the start."""
        customers, tables = self.sizes.astype(float), np.ones(len(self.sizes))
        for number, totals in enumerate(history):
            rng = np.random.default_rng([setting.seed, self.number, number])
            root = setting.root_probability(totals, customers, tables)
            rate = (setting.strength + setting.discount * totals.tables[self.context]) * root[self.word]
            seats = seated(self.count, rate, setting.discount, rng)
            customers = np.bincount(self.word, seats, len(self.sizes))
            new = np.full(len(customers), setting.root_new(totals))
            tables = seated(customers, new, setting.root_discount, rng)
            yield seats, customers, tables


SUMS = "restaurant int, tables double, customers double"


def _sums(counts: DataFrame, run) -> dict[int, tuple[float, float]]:
    """Sums over the buckets per restaurant, number RESTAURANTS standing for the root: bounded, so collected."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bucket = Bucket(row)
                tables, customers, root = run(bucket)
                used = np.flatnonzero(tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(used, RESTAURANTS), pa.int32()),
                        pa.array(np.append(tables[used], root), pa.float64()),
                        pa.array(np.append(customers[used], 0.0), pa.float64()),
                    ],
                    ["restaurant", "tables", "customers"],
                )

    needed = ["bucket", "words", "sizes", "contexts", "numbers"]
    summed = counts.select(*needed).mapInArrow(rows, SUMS).groupBy("restaurant")
    found = summed.agg(F.sum("tables").alias("tables"), F.sum("customers").alias("customers")).collect()
    return {r.restaurant: (r.tables, r.customers) for r in found}


def _totals(sums: dict[int, tuple[float, float]]) -> Totals:
    tables = np.zeros(RESTAURANTS)
    for restaurant, (number, _) in sums.items():
        if restaurant < RESTAURANTS:
            tables[restaurant] = number
    return Totals(tables, float(tables.sum()), sums.get(RESTAURANTS, (0.0, 0.0))[0])


def _start(bucket: Bucket):
    tables = np.bincount(bucket.context, minlength=RESTAURANTS).astype(float)
    customers = np.bincount(bucket.context, bucket.count, RESTAURANTS)
    return tables, customers, float(len(bucket.words))


@dataclass
class Model:
    counts: DataFrame
    buckets: int
    setting: Setting
    history: list[Totals]
    burn_in: int
    parts: list[int]  # per bucket


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def fit(
    docs: DataFrame, key: str, text: str, training: Column, burn_in: int = 1, samples: int = 3, strength: float = 1.0, seed: int = 7
) -> Model:
    """Counts of the training rows, and the sums of each sweep."""
    rows = _rows(docs, key, text, training)
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")).cast("binary")))).first()[0] or 0
    # a word and its blank take about seven bytes
    buckets = max(8, math.ceil(size / 7 / BUCKET))
    sent = rows.filter("training").mapInArrow(lambda batches: _sent_counts(batches, buckets), PARCEL)
    counts = stored(sent.groupBy("bucket").applyInArrow(_counted, COUNTED), "word-counts")
    numbers = ["n_words", "n_tokens", "ones", "twos", "shared_ones", "shared_twos"]
    facts = counts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in numbers)).first()
    start = _sums(counts, _start)
    customers = np.zeros(RESTAURANTS)
    for restaurant, (_, number) in start.items():
        if restaurant < RESTAURANTS:
            customers[restaurant] = number
    setting = Setting(
        facts.n_words, facts.n_tokens, _discount(facts.ones, facts.twos),
        _discount(facts.shared_ones, facts.shared_twos), strength, strength, customers, seed,
    )
    history = [_totals(start)]
    for _ in range(burn_in + samples):

        def swept(bucket: Bucket, history=tuple(history)):
            seats, _, tables = list(bucket.sweeps(setting, history))[-1]
            return np.bincount(bucket.context, seats, RESTAURANTS), np.zeros(RESTAURANTS), float(tables.sum())

        history.append(_totals(_sums(counts, swept)))
    parts = [1] * buckets
    for r in counts.select("bucket", "n_tokens").collect():
        parts[r.bucket] = max(1, math.ceil(r.n_tokens / (2 * BUCKET)))
    return Model(counts, buckets, setting, history, burn_in, parts)


def _rows(docs: DataFrame, key: str, text: str, training: Column) -> DataFrame:
    return bounded(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    )


class Scorer:
    """Predictive probabilities of the words of one bucket, averaged over the samples."""

    def __init__(self, bucket: Bucket | None, model_setting: Setting, history: list[Totals], burn_in: int):
        self.bucket, self.setting = bucket, model_setting
        s = model_setting
        self.back_off, self.root, self.unknown, seen = [], [], [], 0.0
        sweeps = list(bucket.sweeps(s, history[:-1])) if bucket else [(None, None, None)] * (len(history) - 1)
        for totals, (seats, customers, tables) in list(zip(history[1:], sweeps))[burn_in:]:
            self.back_off.append((s.strength + s.discount * totals.tables) / (s.strength + s.customers))
            self.unknown.append(s.root_new(totals) / (s.root_strength + totals.root_customers))
            if bucket:
                self.root.append(s.root_probability(totals, customers, tables))
                seen = seen + (bucket.count - s.discount * seats) / (s.strength + s.customers[bucket.context])
        if bucket:
            self.keys = (bucket.word.astype(np.uint64) << np.uint64(16)) | bucket.context
            self.seen = seen / len(self.back_off)

    def log_probabilities(self, words: np.ndarray, contexts: np.ndarray):
        """(model's log10 probability, base's, known) of tokens."""
        n = len(self.back_off)
        known = np.zeros(len(words), bool)
        count = np.zeros(len(words))
        if self.bucket is not None and len(self.bucket.words):
            own = np.minimum(np.searchsorted(self.bucket.words, words), len(self.bucket.words) - 1)
            known = self.bucket.words[own] == words
            count[known] = self.bucket.word_count[own[known]]
        p = np.zeros(len(words))
        for i in range(n):
            root = np.full(len(words), self.unknown[i])
            if known.any():
                root[known] = self.root[i][own[known]]
            p += self.back_off[i][contexts] * root / n
        if known.any():
            keys = (own.astype(np.uint64) << np.uint64(16)) | contexts
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = known & (self.keys[at] == keys)
            p[hit] += self.seen[at[hit]]
        s = self.setting
        base = np.log10((count + 0.5) / (s.tokens + 0.5 * (s.vocabulary + 1)))
        return np.log10(p), base, known


def _scored(table: pa.Table, setting: Setting, history, burn_in: int) -> pa.Table:
    """One part of a bucket: sums per document of each chunk."""
    rows = table.to_pylist()
    counts = [r for r in rows if r["kind"] == COUNTS]
    bucket = Bucket(counts[0]) if counts else None
    out = [(r["chunk"], r["kind"], r["words"], r["sizes"], None) for r in rows if r["kind"] == DIRECTORY]
    tokens = [r for r in rows if r["kind"] == TOKENS]
    if tokens:
        scorer = Scorer(bucket, setting, history, burn_in)
        for r in tokens:
            words = np.repeat(unpacked(r["words"]), from_planes(r["sizes"], np.uint32))
            documents = from_planes(r["numbers"], np.uint32)
            score, base, known = scorer.log_probabilities(words, from_planes(r["contexts"], np.uint16))
            sums = np.bincount(documents, score)
            base_sums = np.bincount(documents, base)
            out.append(
                (
                    r["chunk"], TOKENS, planes(np.round(-base_sums / UNIT).astype(np.uint64)),
                    planes(np.bincount(documents, known).astype(np.uint32)), planes(sums.astype(np.float32)),
                )
            )
    return pa.Table.from_batches([_batch(out, ARROW_SCORED)])


SCORED = "chunk bigint, kind int, words binary, sizes binary, score binary"
ARROW_SCORED = pa.schema(
    [("chunk", pa.int64()), ("kind", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("score", pa.binary())]
)


def _returned(table: pa.Table, out: pa.Schema) -> pa.Table:
    """The scores of one chunk's documents."""
    rows = table.to_pylist()
    directory = next(r for r in rows if r["kind"] == DIRECTORY)
    keys = pa.ipc.open_stream(directory["words"]).read_all().column(0).combine_chunks()
    sizes = from_planes(directory["sizes"], np.uint32).astype(np.int64)
    base, known, score = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    for r in rows:
        if r["kind"] == TOKENS:
            part = from_planes(r["words"], np.uint64)
            base[: len(part)] += part
            known[: len(part)] += from_planes(r["sizes"], np.uint32)
            score[: len(part)] += from_planes(r["score"], np.float32)
    columns = [keys.cast(out.field(0).type), pa.array(sizes), pa.array(known), pa.array(base * -UNIT), pa.array(score)]
    return pa.Table.from_arrays(columns, schema=out)


def scores(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) per row; the scores are log10 probabilities of the whole text."""
    setting, history, burn_in, buckets = model.setting, model.history, model.burn_in, model.buckets
    rows = _rows(docs, key, text, F.lit(False))
    sent = rows.mapInArrow(lambda batches: _sent_tokens(batches, buckets), PARCEL)
    parts = F.array(*map(F.lit, model.parts))[F.col("bucket")]
    # every part of a bucket gets the bucket's counts; chunks are dealt to the parts
    counted = model.counts.select(
        "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("bigint").alias("chunk"),
        F.lit(COUNTS).alias("kind"), "words", "sizes", "contexts", "numbers",
    )
    dealt = sent.select("bucket", F.pmod(F.xxhash64("chunk"), parts).cast("int").alias("part"), *ARROW_PARCEL.names[1:])
    scored = dealt.unionByName(counted).groupBy("bucket", "part").applyInArrow(
        lambda table: _scored(table, setting, history, burn_in), SCORED
    )
    kind = docs.schema[key].dataType
    names = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    out = T.StructType([T.StructField("key", kind), *(T.StructField(n, t) for n, t in names)])
    arrow_out = to_arrow_schema(out)
    found = scored.groupBy("chunk").applyInArrow(lambda table: _returned(table, arrow_out), out)
    return found.withColumnRenamed("key", key)
