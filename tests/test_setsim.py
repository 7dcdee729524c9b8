from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.functions import minhash
from rillstone.operators import setsim

from .conftest import rows, table

SCHEMA = "key string, member string"


def brute(pairs, threshold):
    sets = {}
    for k, m in pairs:
        if k is not None and m is not None:
            sets.setdefault(k, set()).add(m)
    found = {}
    for a, b in combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold:
            found[a, b] = j
    return found


def test_jaccard_of_two_sets(spark):
    inc = setsim.incidence(table(spark, [("a", x) for x in "123"] + [("b", x) for x in "234"], "k string, m string"), "k", "m")
    assert rows(setsim.exact_pairs(inc, 0.5)) == [("a", "b", 0.5)]
    assert rows(setsim.exact_pairs(inc, 0.51)) == []


def test_nulls_repeats_and_extra_columns(spark):
    df = table(spark, [("a", "1", 7), ("a", "1", 8), ("b", "1", 9), (None, "1", 1), ("c", None, 1)], "k string, m string, n int")
    inc = setsim.incidence(df, "k", "m")
    assert rows(setsim.set_sizes(inc)) == [("a", 1), ("b", 1)]
    assert rows(setsim.exact_pairs(inc)) == [("a", "b", 1.0)]


def test_empty(spark):
    inc = table(spark, [], SCHEMA)
    assert rows(setsim.exact_pairs(inc)) == [] and rows(setsim.lsh_pairs(inc)) == []


@pytest.mark.parametrize("block", [1, 2, 512])
def test_blocked_join_counts_every_pair_once(spark, block):
    pairs = [(f"k{i}", "hot") for i in range(9)] + [("k1", "x"), ("k2", "x")]
    found = rows(setsim.common_members(table(spark, pairs, SCHEMA), block=block))
    assert len(found) == 36 and ("k1", "k2", 2) in found


def test_threshold_of_one_twentieth_is_met(spark):
    pairs = [("a", str(i)) for i in range(1, 11)] + [("b", str(i)) for i in range(10, 21)]
    assert rows(setsim.exact_pairs(table(spark, pairs, SCHEMA), 0.05)) == [("a", "b", 0.05)]


def test_signature_of_fixed_members(spark):
    f = minhash.HashFamily()
    df = spark.range(1).select(minhash.signature(F.array(*[F.lit(x).cast("long") for x in (1, 5, 9)]), f, 3).alias("s"))
    assert df.first().s == [1701, 3404, 5109]
    zero = spark.range(1).select(minhash.signature(F.array(F.lit(4).cast("long")), f, 1, 0).alias("s"))
    assert zero.first().s == [0]


def test_aggregated_signatures_equal_array_signatures(spark):
    inc = table(spark, [("a", x) for x in "acg"] + [("b", x) for x in "bg"], SCHEMA)
    got = {r["key"]: r.sig for r in setsim.signatures(inc, hashes=5).collect()}
    f = minhash.HashFamily()
    number = {m: i for i, m in enumerate("abcg")}
    for key, members in (("a", "acg"), ("b", "bg")):
        want = []
        for i in range(1, 6):
            line = [f.a * number[m] + f.b for m in members]
            want.append(min((i * (x % f.m + x % f.p % f.m) + i * i) % f.p % f.m for x in line))
        assert got[key] == want


def test_bands_reach_the_recall():
    assert minhash.bands_for(0.05, 0.9, 50) == 50 and minhash.bands_for(0.5, 0.9, 50) == 25
    assert 1 - (1 - 0.8**5) ** 10 >= 0.9 > 1 - (1 - 0.8**10) ** 5 and minhash.bands_for(0.8, 0.9, 50) == 10
    with pytest.raises(ValueError):
        minhash.bands_for(0.01, 0.9, 50)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_pairs_found_without_the_most_frequent_members(spark, block):
    pairs = [(f"k{i}", m) for i in range(8) for m in ("hot", "warm")] + [("k1", "x"), ("k2", "x"), ("k2", "y"), ("k3", "y"), ("k3", "x")]
    found = rows(setsim.common_members(table(spark, pairs * 2, SCHEMA), 3, block))
    assert found == [("k1", "k2", 3), ("k1", "k3", 3), ("k2", "k3", 4)]


def test_hot_keys_and_members_are_split_and_nulls_drop_out(spark, monkeypatch):
    monkeypatch.setattr(setsim, "ROWS", 2)
    pairs = [("a", str(i)) for i in range(9)] + [("b", str(i)) for i in range(6)] + [(None, "1"), ("c", None), ("c", "1")]
    assert rows(setsim.exact_pairs(table(spark, pairs, SCHEMA), 0.5)) == [("a", "b", 6 / 9)]
    assert rows(setsim.supported(table(spark, pairs[:15], SCHEMA), 7)) == sorted(pairs[:9])
    assert rows(setsim.lsh_pairs(table(spark, pairs, SCHEMA), 0.5)) == [("a", "b", 6 / 9)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("123456789")), min_size=1, max_size=40))
def test_lsh_is_within_exact_and_index_zero_is_exact(spark, pairs):
    want = brute(pairs, 0.3)
    inc = table(spark, pairs, SCHEMA).distinct()
    exact = {(a, b): s for a, b, s in rows(setsim.exact_pairs(inc, 0.3))}
    assert exact == pytest.approx(want)
    assert {r[:2] for r in rows(setsim.lsh_pairs(inc, 0.3, hashes=4, bands=2))} <= set(want)
    assert {r[:2] for r in rows(setsim.lsh_pairs(inc, 0.3, hashes=4, bands=4, first=0))} == set(want)
