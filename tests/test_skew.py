from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillstone.operators import skew

from .conftest import rows, table

S = "k string, v int, note string"


def skewed(spark, extra=()):
    data = [("hot", i, None) for i in range(600)] + [(f"k{i % 40}", i, "x") for i in range(400)] + list(extra)
    return table(spark, data, S)


def test_pack_splits_and_balances():
    heavy, buckets, loads = skew.pack([("h", 900), ("g", 90)], [5] * 22, 10)
    shards = dict(heavy)["h"]
    assert len(shards) == len(set(shards)) == 9 and len(dict(heavy)["g"]) == 1
    assert max(loads) <= 1.3 * sum(loads) / 10 and len(buckets) == 22
    assert skew.pack([], [0, 0], 2)[2] == [0.0, 0.0]


def test_rows_are_spread_and_kept(spark):
    df = skewed(spark)
    plan = skew.plan_tasks(df, "k", 8)
    sent = skew.scatter(df, "k", plan)
    loads = [n for (n,) in sent.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    assert sum(loads) == 1000 and max(loads) < 1.6 * 1000 / 8


def test_join_equals_plain_join(spark):
    df = skewed(spark, [(None, 1, "n"), (None, 2, None), ("alone", 3, "y")])
    match = table(spark, [("hot", "a"), ("hot", "b"), ("k1", "c"), (None, "n"), ("nobody", "z")], "k string, note string")
    for how in ("inner", "left"):
        want = df.join(match.withColumnRenamed("note", "note_match"), "k", how).select("k", "v", "note", "note_match")
        got = skew.balanced_join(df, match, "k", how, skew.plan_tasks(df, "k", 8)).select("k", "v", "note", "note_match")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        skew.balanced_join(df, match, "k", "outer")


def test_join_adds_no_exchange_of_its_own(spark):
    df = skewed(spark)
    match = table(spark, [("hot", "a")], "k string, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.balanced_join(df, match, "k", plan=skew.plan_tasks(df, "k", 4))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange shufflepartitionid") == 2 and plan.count("Exchange hashpartitioning") == 0


def test_aggregate(spark):
    df = skewed(spark, [(None, 1, None)])
    got = rows(skew.balanced_aggregate(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}))
    want = rows(df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)), F.sum("v")))
    assert got == want


def test_heavy_keys_at_the_limit(spark):
    df = table(spark, [("a",)] * 10 + [("b",)] * 9 + [(None,)] * 981, "k string")
    assert [r[:2] for r in rows(skew.heavy_keys(df, "k", 0.01))] == [("a", 10)]


def test_one_key_and_empty(spark):
    one = table(spark, [("a", 1, "x")] * 50, S)
    assert rows(skew.balanced_aggregate(one, "k", {"n": F.count(F.lit(1))}, {"n": F.sum("n")})) == [("a", 50)]
    none = table(spark, [], S)
    assert rows(skew.heavy_keys(none, "k", 0.01)) == []
    assert rows(skew.balanced_join(none, one, "k")) == []
