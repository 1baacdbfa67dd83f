"""BPE by tree reduction against the public library, and round trips."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from labelproof.llm import bpe, queries


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairEncoder(bpe.read_ranks(queries.VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={}
    )


@pytest.mark.parametrize("alphabet", ["a", "ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "é日ab", " \n\t", "=-+", "a1 .\u0085 "])
def test_equals_library(encoder, library, alphabet):
    rng = random.Random(3)
    for n in (0, 1, 2, 23, 24, 25, 97, 1000, 20000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_direct_merging_and_heap_agree(encoder):
    rng = random.Random(4)
    for _ in range(200):
        data = bytes(rng.choice(b"thean ") for _ in range(rng.randrange(1, 60)))
        assert encoder.merged(data) == encoder._merged_by_heap(data) == encoder.tokens(data)


def test_rows(spark, encoder, library):
    rows = [(1, "Some text,  twice", 7), (1, "Some text,  twice", 7), (2, None, 8), (3, "", 9), (None, "<|endoftext|>" * 900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    ids = bpe.encoded(docs, ["doc_id"], "text", encoder)
    back = bpe.decoded(ids, ["doc_id"], "ids", encoder.ranks).collect()
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in back)
    want = sorted((str(k), library.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in rows)
    assert got == want
    assert bpe.decoded(ids.limit(0), ["doc_id"], "ids", encoder.ranks).count() == 0


def test_query(spark, folder, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_byte_level_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_is_one_step_in_python(spark, encoder):
    rows = [(1, "Some text,  twice", 7), (1, "Some text,  twice", 7), (2, None, 8), (3, "", 9), (None, "é日\n" * 900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    whole = bpe.round_trip(docs, ["doc_id"], "text", encoder)
    parts = bpe.decoded(bpe.encoded(docs, ["doc_id"], "text", encoder), ["doc_id"], "ids", encoder.ranks)
    assert whole.schema == parts.schema
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert bpe.round_trip(docs.limit(0), ["doc_id"], "text", encoder).count() == 0


def test_pipeline_encodes_and_decodes_in_one_worker(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # two steps take two Python workers for each core, which an executor keeps
    for rows in (corpus_pipeline.byte_level_bpe(spark, docs, folder), queries.QUERIES["op1_byte_level_bpe"](spark, folder)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
