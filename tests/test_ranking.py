"""Ranks, totals and quantiles against plain Python, with one group holding a third of the rows and heavy ties."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelproof.operators import ranking as rk
from labelproof.operators.skew import group_parts, join_group_row, lookup_by_heavy_key


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(12)}"
        value = 7.5 if rng.random() < 0.3 else round(rng.lognormvariate(0, 2), 3)
        out.append((i, group, value if i % 17 else None))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, g string, v double").cache()


@pytest.mark.parametrize("partitions", [1, 17])
def test_numbered(frame, rows, partitions):
    shuffled = frame.repartition(partitions)
    out = rk.numbered(rk.value_slice(shuffled, "id"), ["g"], ["id"], total="n").collect()
    want = pd.DataFrame(rows, columns=["id", "g", "v"]).sort_values("id")
    want["r"] = want.groupby("g").cumcount() + 1
    want["n"] = want.groupby("g")["id"].transform("size")
    assert {(r["id"], r["rank"], r["n"]) for r in out} == set(want[["id", "r", "n"]].itertuples(index=False, name=None))


def test_hash_ranks_ignore_input_order(frame):
    def ranks(df):
        drawn = df.withColumn("d", rk.hash_draw(42, "id"))
        out = rk.numbered(drawn.withColumn(rk.SLICE, rk.draw_slice(F.col("d"))), ["g"], ["d", "id"])
        return {(r["id"], r["rank"]) for r in out.select("id", "rank").collect()}

    assert ranks(frame) == ranks(frame.orderBy(F.desc("id")).repartition(13))


def test_quantiles(frame, rows):
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = ["a", "b", "c", "d", "e"]
    out = rk.exact_quantiles(frame, ["g"], "v", probabilities, names).collect()
    data = pd.DataFrame(rows, columns=["id", "g", "v"]).dropna()
    for r in out:
        want = np.quantile(data.loc[data["g"] == r["g"], "v"], probabilities)
        assert [r[n] for n in names] == pytest.approx(list(want))
    assert len(out) == data["g"].nunique()


def test_quantiles_over_all_rows(frame, rows):
    row = rk.exact_quantiles(frame, [], "v", [0.5], ["m"]).first()
    assert row["m"] == pytest.approx(pd.Series([r[2] for r in rows]).median())


def test_percent_rank_matches_average_ties(frame, rows):
    out = {r["id"]: r["p"] for r in rk.average_percent_rank(frame, "v", "p").collect()}
    want = pd.Series([r[2] for r in rows]).rank(pct=True)
    for i, p in want.items():
        assert (out[i] is None) if pd.isna(p) else out[i] == pytest.approx(p)


def test_closest_to_median(frame, rows):
    out = {r["g"]: r["id"] for r in rk.closest_to_median(frame, ["g"], "v", "id").collect()}
    data = pd.DataFrame(rows, columns=["id", "g", "v"]).dropna()
    for g, part in data.groupby("g"):
        distance = (part["v"] - part["v"].median()).abs()
        assert distance[part["id"] == out[g]].iloc[0] == pytest.approx(distance.min(), abs=1e-12)


def test_top_rows_prune_before_the_shuffle(frame):
    plan = rk.top_rows(frame, ["g"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert "WindowGroupLimit" in plan and plan.index("hashpartitioning") < partial


def test_accept_cap(spark):
    rng = random.Random(5)
    data = [(i, "a" if i % 4 else "b", rng.random() < 0.4) for i in range(200)] + [(1000, "c", False)]
    out = rk.accepted_until(spark.createDataFrame(data, "i int, t string, ok boolean"), "t", "i", "ok", 5)
    want, accepted = set(), {}
    for i, t, ok in data:
        if accepted.get(t, 0) < 5:
            want.add(i)
            accepted[t] = accepted.get(t, 0) + ok
    assert {r["i"] for r in out.collect()} == want


def test_first_accepted(spark):
    data = [(1, "x", False), (2, "x", True), (3, "x", True), (4, "y", False), (5, "z", True)]
    out = rk.first_accepted(spark.createDataFrame(data, "i int, e string, ok boolean"), "e", "i", "ok")
    assert {r["i"] for r in out.filter("is_first").collect()} == {2, 5}
    assert out.count() == 5


def test_heavy_key_lookup_keeps_every_row(spark, frame):
    table = frame.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    for hot in (1, 4, 1000):
        joined = lookup_by_heavy_key(frame.select("id", "g"), table, "g", "n", hot)
        assert joined.count() == 900
        assert joined.filter("g = 'hot'").select("n").distinct().first()[0] == frame.filter("g = 'hot'").count()


def test_nan_and_null_have_no_rank(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (2, nan), (3, 3.0), (4, None), (5, 3.0)], "id int, v double")
    ranks = {r["id"]: r["p"] for r in rk.average_percent_rank(df, "v", "p").collect()}
    assert ranks == {1: 1 / 3, 2: None, 3: 2.5 / 3, 4: None, 5: 2.5 / 3}
    assert rk.exact_quantiles(df, [], "v", [0.5], ["m"]).first()["m"] == 3.0


def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return before


def test_large_groups_are_spread_by_their_size(spark):
    plain = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = settings(spark, **plain)
    try:
        i = F.col("id")
        g = F.when(i < 12000, 0).when(i < 15000, 1).when(i < 18000, F.lit(None)).otherwise(i % 500 + 2)
        df = spark.range(20000).withColumn("g", g).withColumn("h", i % 2)
        parts = {r.g: r["__parts"] for r in group_parts(df, ["g"], part_rows=500).collect()}
        assert parts == {0: 24, 1: 6}
        # a bounded list whatever the number of large groups
        assert group_parts(df, ["g"], part_rows=1, most=10).agg(F.sum("__parts")).first()[0] <= 20
        table = df.groupBy("g").agg(F.sum("id").alias("s"))
        want = df.filter("g IS NOT NULL").count()
        for how, rows in (("inner", want), ("left", 20000)):
            joined = join_group_row(df, table, ["g"], how, part_rows=500)
            assert joined.columns == ["g", "id", "h", "s"] and joined.count() == rows
            tasks = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert tasks < 2000
            assert joined.filter("g = 0").select("s").distinct().first()[0] == sum(range(12000))
        assert joined.filter("g IS NULL AND s IS NULL").count() == 3000
        two = join_group_row(df, df.groupBy("g", "h").agg(F.count("*").alias("n")), ["g", "h"], part_rows=500)
        assert two.count() == want and two.filter("g = 0 AND n <> 6000").count() == 0
        assert join_group_row(df.limit(0), table, ["g"]).count() == 0
    finally:
        settings(spark, **before)


def test_group_rows_are_dealt_by_group_and_part(spark):
    before = settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    try:
        df = spark.range(100).withColumn("g", F.col("id") % 2)
        joined = rk.with_group_row(df, df.groupBy("g").agg(F.sum("id").alias("s")), ["g"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
        facts = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__part" in line]
        assert len(facts) == 2
    finally:
        settings(spark, **before)
