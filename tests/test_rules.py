from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelproof.functions import text as tx
from labelproof.functions import vectors as vx
from labelproof.operators import balance, gates, joins, profile, reshape, rules
from labelproof.operators.rules import Rule
from labelproof.schemas import EFFECTS

METADATA = """name: "Example Wide"
category: "WIDE_OPEN"
license: "OFL"
fonts {
  name: "inner"
  filename: "ExampleSans-Regular.ttf"
}
fonts {
  filename: "ExampleSans-Bold.ttf"
}
subsets: "latin"
subsets: "menu"
"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_metadata_fields(spark):
    m = one(spark, tx.metadata_fields(F.lit(METADATA)))
    assert (m["name"], m["category"], m["license"]) == ("Example Wide", "WIDE_OPEN", "OFL")
    assert m["filenames"] == ["ExampleSans-Regular.ttf", "ExampleSans-Bold.ttf"]
    assert m["subsets"] == ["latin", "menu"]


@pytest.mark.parametrize(
    "names, picked",
    [
        (["A-Bold.ttf", "A-Regular.ttf"], "A-Regular.ttf"),
        (["A-Italic[wght].ttf", "A[wght].ttf"], "A-Italic[wght].ttf"),
        (["A-Italic.ttf", "A-Bold.otf"], "A-Bold.otf"),
        (["A-Italic.ttf"], "A-Italic.ttf"),
        (["readme.md"], None),
        ([], None),
    ],
)
def test_preferred_name(spark, names, picked):
    array = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    preferred = ("Regular.ttf", "Regular.otf", "[wght].ttf", "-VariableFont_wght.ttf")
    assert one(spark, tx.preferred_name(array, r"\.(ttf|otf)$", preferred, "italic")) == picked


def test_slugs_and_labels(spark):
    assert one(spark, tx.safe_slug(F.lit("  Ab c/d-1.0_ "))) == "Ab_c_d-1.0"
    assert one(spark, tx.lower_slug(F.lit("Model Nine (24)"))) == "model_nine_24"
    assert one(spark, tx.entity_key(F.lit("No. 4 Main-Street"))) == "no4mainstreet"
    assert one(spark, tx.display_label(F.lit("north_west"))) == "North west"
    assert one(spark, tx.title_label(F.lit("north_west"))) == "North West"
    assert one(spark, tx.range_label(F.lit(0.1), F.lit(0.2))) == "0.1–0.2"


def test_json_problem_accepts_null_values(spark):
    assert one(spark, tx.json_problem(F.lit('{"a": null, "b": 1}'), ["a", "b"])) == ""
    assert one(spark, tx.json_problem(F.lit('{"b": 1}'), ["a", "b"])) == "missing fields: a"
    assert one(spark, tx.json_problem(F.lit("{"), ["a"])) == "invalid JSON"
    assert one(spark, tx.json_problem(F.lit(None).cast("string"), ["a"])) == "invalid JSON"


def test_softmax_and_validity(spark):
    p = one(spark, vx.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]
    probs = F.array(F.lit(0.7), F.lit(0.3))
    assert one(spark, vx.probability_problem(probs, F.lit("a"), ["a", "b"])) == ""
    assert one(spark, vx.probability_problem(probs, F.lit("b"), ["a", "b"])) == "label is not the argmax"
    assert one(spark, vx.probability_problem(F.array(F.lit(0.7)), F.lit("a"), ["a", "b"])) == "wrong length"
    assert one(spark, vx.probability_problem(F.lit(None).cast("array<double>"), F.lit("a"), ["a", "b"])) == "wrong length"


def test_argmax_takes_the_first_maximum(spark):
    assert one(spark, vx.argmax_label(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)), ["x", "y", "z"])) == "x"


def test_first_failure_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50), (4, 500)], "id int, v int")
    out = rules.first_failure(df, [Rule(F.col("v").isNull(), "null"), Rule(F.col("v") < 10, "small"), Rule(F.col("v") < 100, "medium")])
    assert [(r["reason"], r["usable"]) for r in out.orderBy("id").collect()] == [("null", False), ("small", False), ("medium", False), ("", True)]


def test_admission(spark):
    rows = [
        ("image/gif", 10, 50, 50, 30.0, 0.0, 200.0, "unsupported type"),
        ("image/png", 0, 50, 50, 30.0, 0.0, 200.0, "empty input"),
        ("image/png", 5 * 2**20, 50, 50, 30.0, 0.0, 200.0, "too many bytes"),
        ("image/png", 10, None, None, None, None, None, "unreadable"),
        ("image/png", 10, 5000, 5000, 30.0, 0.0, 200.0, "too many pixels"),
        ("image/png", 10, 19, 50, 30.0, 0.0, 200.0, "too small"),
        ("image/png", 10, 6001, 50, 30.0, 0.0, 200.0, "too large"),
        ("image/jpeg", 10, 50, 50, 1.9, 0.0, 200.0, "blank or nearly blank"),
        ("image/jpeg", 10, 50, 50, 4.0, 10.0, 14.0, "blank or nearly blank"),
        ("image/jpeg", 10, 50, 50, 4.0, 10.0, 15.0, ""),
    ]
    names = "content_type string, length bigint, width int, height int, std double, p01 double, p99 double, want string"
    out = rules.first_failure(spark.createDataFrame(rows, names), rules.admission_rules())
    assert all(r["reason"] == r["want"] for r in out.collect())


def test_effect_flags_on_nulls(spark):
    row = spark.range(1).select(F.from_json(F.lit("{}"), EFFECTS).alias("e")).select("e.*")
    flags = row.select(*[c.alias(n) for n, c in rules.effect_flags().items()]).first().asDict()
    assert not any(flags[n] for n in ("dark_background", "soft_contrast", "blur_applied", "jpeg_applied", "rotation_applied"))


def test_split_restriction_requires_every_split(spark):
    df = spark.createDataFrame([("train",), ("test",)], "split string")
    with pytest.raises(ValueError, match="validation"):
        rules.require_splits(df, ["train", "validation"])


def test_split_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.range(10).withColumn("split", F.lit("train")).write.parquet(path)
    plan = rules.allowed_splits(spark.read.parquet(path), ["train", "validation"]).select("split")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(split, [train,validation])]" in plan


def test_audit_summary(spark):
    rows = [("A", "red", "red", True), ("A", "red", "red", True), ("B", "red", "red", False)]
    df = spark.createDataFrame(rows, "entity string, actual string, listed string, usable boolean")
    out = profile.audit_summary(df, ["red", "blue"], entity="entity", actual="actual", listed="listed", usable="usable")
    assert {tuple(r) for r in out.collect()} == {("red", 1, 1, 3), ("blue", 0, 0, 0)}


def test_column_profile_and_constants(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "a", "k"), (3, None, "k")], "user_id int, s string, c string")
    out = {r["column"]: (r["nulls"], r["distinct_values"]) for r in profile.column_profile(df).collect()}
    assert out == {"user_id": (0, 3), "s": (2, 2), "c": (0, 1)}
    assert [r[0] for r in profile.constant_columns(profile.column_profile(df)).collect()] == ["c"]
    assert profile.identifier_like(df.columns + ["Id", "id_x", "idea"]) == ["user_id", "Id", "id_x"]


def test_imbalance_only_for_two_values(spark):
    two = spark.createDataFrame([(1,)] * 9 + [(0,)], "t int")
    three = two.union(spark.createDataFrame([(2,)], "t int"))
    assert profile.imbalance_status(profile.target_distribution(two, "t")).first()["status"] == "WARN"
    assert profile.imbalance_status(profile.target_distribution(three, "t")).first()["status"] == "PASS"


def test_time_boundary_with_no_dates_passes(spark):
    df = spark.createDataFrame([("train", None), ("test", None)], "split string, ts timestamp")
    assert profile.time_boundary(df, "ts").first()["chronological"] is True


def test_equal_schedules_have_no_association(spark):
    rows = [(x, t) for x in "abcdef" for t in ("p", "q", "r") for _ in range(4)]
    row = balance.association(spark.createDataFrame(rows, "x string, t string"), "x", "t").first()
    assert row["cramers_v"] == pytest.approx(0, abs=1e-6) and row["max_rate_spread"] == 0 and not row["strong"]


def test_full_association(spark):
    rows = [(x, t) for x, t in (("a", "p"), ("b", "q")) for _ in range(10)]
    row = balance.association(spark.createDataFrame(rows, "x string, t string"), "x", "t").first()
    assert row["cramers_v"] == pytest.approx(1.0) and row["max_rate_spread"] == 1.0 and row["strong"]


def test_single_value_has_zero_association(spark):
    row = balance.association(spark.createDataFrame([("a", "p"), ("a", "q")], "x string, t string"), "x", "t").first()
    assert row["cramers_v"] == 0.0


def test_tampered_signature_is_found(spark):
    rows = [(t, s) for t in ("p", "q", "r") for s in ("x", "x", "y")]
    df = spark.createDataFrame(rows, "t string, s string")
    assert balance.unequal_multisets(df, "t", "s", "p").count() == 0
    changed = spark.createDataFrame([*rows[:-1], ("r", "z")], "t string, s string")
    assert [r["target"] for r in balance.unequal_multisets(changed, "t", "s", "p").collect()] == ["r"]


def test_lookup_and_listing(spark):
    table = {"OFL": "open", "APACHE2": "apache"}
    assert one(spark, joins.lookup_constant(F.lit("OFL"), table)) == "open"
    assert one(spark, joins.lookup_constant(F.lit("X"), table, "none")) == "none"
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {tuple(r) for r in joins.listing_difference(a, b, "k").collect()} == {("x", "on_disk"), ("z", "listed")}


def test_run_comparison(spark):
    a = spark.createDataFrame([(1, [0.6, 0.4], "x"), (2, [0.6, 0.4], "x"), (3, [0.6, 0.4], "x")], "id int, p array<double>, label string")
    b = spark.createDataFrame([(1, [0.6, 0.4], "x"), (2, [0.61, 0.39], "x"), (3, [0.6, 0.4], "y")], "id int, p array<double>, label string")
    out = {r["id"]: r["status"] for r in joins.compare_runs(a, b, "id", "p", ["label"], 1e-5).collect()}
    assert out == {1: "PASS", 2: "FAIL", 3: "FAIL"}


def test_gate_decision(spark):
    def decide(*statuses):
        return profile.gate_decision(spark.createDataFrame([(s,) for s in statuses], "status string")).first()["decision"]

    assert decide("PASS", "FAIL", "WARN") == "RED"
    assert decide("PASS", "MANUAL") == "YELLOW"
    assert decide("PASS") == "GREEN"


def test_domain_order(spark):
    df = spark.createDataFrame([("PASS",), ("odd",), ("FAIL",), ("WARN",)], "status string")
    assert [r[0] for r in df.orderBy(reshape.in_order("status", gates.SEVERITY)).collect()] == ["FAIL", "WARN", "PASS", "odd"]


def test_self_check_of_a_leaking_table(spark):
    rows = [("a", "x", "train", 1), ("a", "y", "val", 2), ("b", "x", "train", 3)]
    df = spark.createDataFrame(rows, "g string, t string, split string, n int")
    out = gates.self_check(df, gates.SelfCheck(target="t", split="split", group="g"))
    status = {r["check_name"]: r["status"] for r in out.collect()}
    assert status["group overlap"] == "FAIL" and status["exact duplicate rows"] == "PASS"
    assert out.first()["status"] == "FAIL"
    missing = gates.self_check(df, gates.SelfCheck(target="nope", split="split"))
    assert {r["check_name"]: r["status"] for r in missing.collect()}["target column exists"] == "FAIL"


def test_structure_gate_finds_a_leak(spark):
    rows = [("i1", "a", "t", "train"), ("i2", "b", "t", "validation"), ("i3", "c", "t", "test")]
    names = "k string, e string, t string, s string"
    good = spark.createDataFrame(rows, names)
    options = dict(key="k", entity="e", target="t", split="s", targets=["t"], splits=["train", "validation", "test"], expected_items=3)
    assert gates.structure_gate(good, good, **options).filter("status = 'FAIL'").count() == 0
    leaked = good.union(spark.createDataFrame([("i4", "a", "t", "test")], names))
    failed = {r["check_name"] for r in gates.structure_gate(leaked, good, **options).filter("status = 'FAIL'").collect()}
    assert failed == {"item count", "entity leakage", "assignment match"}
