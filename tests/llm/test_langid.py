"""Language identification on held-out rows and on awkward ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.llm import langid, queries


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = queries.QUERIES["op6_language_id"](spark, folder.replace("sf0.001", "sf0.01"))
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, total = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert total > 150 and right >= 0.97
    assert found.filter("score < 0 OR score > 1").count() == 0
    # clean rows stay: few are rejected
    assert found.filter("rejected").count() <= 0.02 * found.count()


def rows(spark):
    english = "the quick brown fox and the lazy dog of the house with that thing "
    german = "der schnelle braune fuchs und der faule hund von dem haus mit diesem ding "
    data = [(i, english * (1 + i % 3), "en", "s") for i in range(0, 40, 2)]
    data += [(i, german * (1 + i % 3), "de", "s") for i in range(1, 40, 2)]
    data += [
        (100, None, "en", "s"),
        (101, "", None, None),
        (102, "12 34 ... !!", "en", "s"),
        (103, german * 5000, None, "s"),
        (104, "the dog and the fox", None, "s"),
        (104, "the dog and the fox", None, "s"),
        (None, "der hund und der fuchs", None, "s"),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, score string")


def test_rows(spark):
    docs = rows(spark)
    model = langid.fit(docs, "doc_id", "text", "lang", F.col("doc_id") < 100)
    found = langid.predictions(docs, ["doc_id"], "text", model).collect()
    assert len(found) == 47
    got = {r.doc_id: r for r in found}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (100, 101, 102))
    assert got[103].lang_pred == "de" and got[None].lang_pred == "de" and got[104].lang_pred == "en"
    clean = langid.known_language(docs, "text", model)
    assert clean.columns == docs.columns and clean.count() == 44


def test_without_labels_and_without_rows(spark):
    docs = rows(spark)
    model = langid.fit(docs, "doc_id", "text", "lang", F.lit(False))
    assert {r.lang_pred for r in langid.predictions(docs, ["doc_id"], "text", model).collect()} == {"und"}
    assert langid.predictions(docs.limit(0), ["doc_id"], "text", model).count() == 0
    one = langid.fit(docs, "doc_id", "text", "lang", F.col("lang") == "de")
    assert one.predict(b"anything")[0] == "de"


def test_a_narrow_margin_is_rejected():
    model = langid.LanguageModel({"a": [b"same content here"] * 2, "b": [b"same content here"] * 2})
    assert model.predict(b"same content") == ("a", 0.5, True)
