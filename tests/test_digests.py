"""Digests of tables and the keys in which two of them differ."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from labelproof.operators import digests


@pytest.fixture()
def table(spark):
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i < 2900, i % 2000).alias("k"), F.concat(F.lit("t"), (i % 7).cast("string")).alias("a"), (i * 0.5).alias("v")
    )


def changes(df, path):
    return {r.k: r.change for r in digests.changed_keys(df, ["k"], path).collect()}


def test_nothing_changed(spark, table, tmp_path):
    digests.record(table, ["k"], str(tmp_path / "r"))
    assert changes(table.repartition(13).select("v", "k", "a"), str(tmp_path / "r")) == {}


def test_exactly_the_changed_keys(spark, table, tmp_path):
    path = str(tmp_path / "r")
    digests.record(table, ["k"], path)
    rows = [tuple(r) for r in table.collect()]
    rng = random.Random(1)
    edited, touched = [], {}
    for k, a, v in rows:
        draw = rng.random()
        if draw < 0.01:
            touched[k] = "x"
            continue
        if draw < 0.02:
            a, touched[k] = "other", "x"
        elif draw < 0.03:
            edited.append((k, a, v))
            touched[k] = "x"
        edited.append((k, a, v))
    edited += [(9000, "new", None), (9001, None, 1.0)]
    now = spark.createDataFrame(edited, "k long, a string, v double")
    found = changes(now, path)
    before, after = {r[0] for r in rows}, {r[0] for r in edited}
    assert set(found) == {*touched, 9000, 9001}
    for k, change in found.items():
        assert change == ("added" if k not in before else "removed" if k not in after else "changed")


def test_edits_that_cancel_are_seen(spark, table, tmp_path):
    path = str(tmp_path / "r")
    digests.record(table, ["k"], path)
    # two keys exchange their contents: the bag of contents stays as it was
    swap = F.when(F.col("k") == 5, 6).when(F.col("k") == 6, 5).otherwise(F.col("k"))
    assert changes(table.withColumn("k", swap), path) == {5: "changed", 6: "changed"}
    a, b = digests.table_digest(table).first(), digests.table_digest(table.withColumn("k", swap)).first()
    assert a.rows == b.rows and a.fingerprint != b.fingerprint


def test_empty_tables(spark, table, tmp_path):
    digests.record(table.limit(0), ["k"], str(tmp_path / "r"))
    assert changes(table.limit(0), str(tmp_path / "r")) == {}
    few = table.filter("k < 3")
    assert set(changes(few, str(tmp_path / "r")).values()) == {"added"}
    digests.record(few, ["k"], str(tmp_path / "s"))
    assert set(changes(few.limit(0), str(tmp_path / "s")).values()) == {"removed"}


def test_equal_leaves_are_not_read_by_key(spark, table, tmp_path):
    path = str(tmp_path / "r")
    digests.record(table, ["k"], path)
    now = table.withColumn("a", F.when(F.col("k") == 77, "other").otherwise(F.col("a")))
    plan = digests.changed_keys(now, ["k"], path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "node" in plan
    assert changes(now, path) == {77: "changed"}


def test_sums_of_levels_agree(spark, table):
    rows = digests.keyed_rows(table, ["k"])
    leaves = digests.leaves_of(rows)
    whole = digests.added(leaves).select("rows", F.sha2(F.concat_ws(",", *digests.LANES), 256).alias("fingerprint")).first()
    assert whole == digests.table_digest(table).first()
