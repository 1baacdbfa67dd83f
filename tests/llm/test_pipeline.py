"""The pipeline against brute force, stage by stage, and on awkward documents."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F
from test_decontam import brute_force as contamination
from test_line_dedup import brute_force as without_repeats
from test_ngram_join import brute_force as near_copies

from labelproof.llm import bpe, decontam, langid
from labelproof.llm.folds import fold


@pytest.fixture(scope="module")
def outputs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], folder).cache())
    return frames


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(outputs):
    for frame in outputs[1:-1]:
        assert frame.columns == outputs[0].columns


def test_language(outputs):
    docs = outputs[0]
    training = F.coalesce(fold("doc_id", 4) != 2, F.lit(False))
    model = langid.fit(docs, "doc_id", "text", "lang", training)
    want = {k: t for k, t in texts(docs).items() if not model.predict(t.encode())[2]}
    assert texts(outputs[1]) == want and len(want) > 0.95 * docs.count()


def test_lines(outputs):
    rows = [(k, t) for k, t in texts(outputs[1]).items() if t.count("\n") < 60]
    want = without_repeats(rows, 51)
    got = texts(outputs[2])
    for (key, before), after in want.items():
        if after == before or after.strip():
            assert got[key] == after
        else:
            assert key not in got


def test_near_copies(outputs):
    groups = near_copies(list(texts(outputs[2]).items()))
    assert set(texts(outputs[3])) == {key for key, _, root in groups if key == root}


def test_contamination(spark, outputs, folder):
    items = [decontam.words_of(r.text.encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = set()
    for key, text in texts(outputs[3]).items():
        n, hit, _ = contamination(text.encode(), items, 13)
        if not (hit and 20 * len(hit) >= n):
            want.add(key)
    assert set(texts(outputs[4])) == want


def test_tokens(outputs):
    encoder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY), special_tokens={}
    )
    before = texts(outputs[4])
    rows = outputs[5].collect()
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        assert r.token_ids == encoder.encode_ordinary(before[r.doc_id]) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_run_equals_its_stages(spark, outputs, folder):
    got = sorted((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted((r.doc_id, r.decoded_sha256) for r in outputs[5].collect())


def test_awkward_documents(spark, folder):
    german = "der schnelle braune fuchs und der faule hund von dem haus mit diesem ding "
    rows = [(i, german + f"nummer {i} " + "wort" * i, "de", "s", 1) for i in range(8)]
    rows += [
        (20, None, None, None, None),
        (21, "", "de", "s", 0),
        (22, german * 4000, None, "s", None),
        (None, "ein haus mit hund und fuchs", "de", None, 3),
        (3, german + "nummer 3 wortwortwort", "de", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(1) for n in ("digest", "first", "n_removed", "deleted", "d1", "c0", "c1", "key")})
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, folder)
            if name != "byte_level_bpe":
                assert frame.columns == docs.columns, name
        assert {r.doc_id for r in frame.collect()} <= {*range(8), 22, None}
