import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rillstone.operators import blocks, ratings, setsim

from .conftest import rows, table

SCHEMA = "key string, member string"


def some(seed, keys=40, members=25, hot=("hot", "warm")):
    """Distinct rows of sets with hot members, as a dict of sets."""
    rng = random.Random(seed)
    return {f"k{i}": {h for h in hot if rng.random() < 0.7} | {f"m{rng.randrange(members)}" for _ in range(rng.randrange(1, 9))} for i in range(keys)}


@pytest.mark.parametrize(("count", "at_once"), [(1, 10**6), (1, 1), (2, 7), (5, 100)])
def test_blocks_lose_and_repeat_no_pair(spark, count, at_once, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 3)
    sets = some(1)
    packed, _ = blocks.packed(table(spark, [(k, m) for k, s in sets.items() for m in s], SCHEMA), 2)
    got = rows(blocks.counted(packed, count, 2, at_once=at_once))
    large = {k: s for k, s in sets.items() if len(s) >= 2}
    want = [(a, b, len(large[a] & large[b]), len(large[a]), len(large[b])) for a, b in combinations(sorted(large), 2) if len(large[a] & large[b]) >= 2]
    assert len(want) > 100 and got == sorted(want, key=str)


def test_pairs_of_a_hot_member_never_meet_in_a_join(spark):
    df = table(spark, [(k, m) for k, s in some(2).items() for m in s], SCHEMA)
    rated = df.select(F.col("key").alias("item"), F.col("member").alias("user"), F.lit(3.0).alias("stars"))
    for found in (setsim.common_members(df, 3), setsim.exact_pairs(df), ratings.pearson_pairs(rated, "item")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1


def test_work_and_rows_decide_the_number_of_blocks():
    assert blocks.blocks_for(0, 0, 12) == 1 and blocks.blocks_for(1e5, 1000, 12) == 1
    assert blocks.blocks_for(22e6, 435_000, 12) == 5 and blocks.blocks_for(5e9, 1, 12) == 23
    assert blocks.blocks_for(1e6, 50_000_000, 12) == 100


@pytest.mark.parametrize("count", [1, 4])
def test_sums_are_those_of_the_common_members(spark, count):
    rng = random.Random(3)
    sets = {k: {m: float(rng.randrange(1, 6)) for m in s} for k, s in some(4, 20).items()}
    packed, _ = blocks.packed(table(spark, [(k, m, r) for k, s in sets.items() for m, r in s.items()], SCHEMA + ", r double"))
    got = {r[:2]: r[5:] for r in rows(blocks.counted(packed, count))}
    assert len(got) > 50
    for (a, b), sums in got.items():
        x, y = zip(*[(sets[a][m], sets[b][m]) for m in sets[a].keys() & sets[b].keys()])
        assert sums == (sum(x), sum(y), sum(v * v for v in x), sum(v * v for v in y), sum(v * w for v, w in zip(x, y)))


@pytest.mark.parametrize(("hashes", "bands"), [(6, 6), (6, 3)])
def test_a_pair_at_the_threshold_needs_a_common_bucket(spark, hashes, bands):
    df = table(spark, [(k, m) for k, s in some(5).items() for m in s], SCHEMA)
    keys = setsim.band_keys(setsim.signatures(df, hashes=hashes), bands, hashes // bands)
    near = {r[:2] for r in rows(setsim.candidates(keys))}
    want = [r for r in rows(setsim.exact_pairs(df, 0.1)) if r[:2] in near]
    assert 0 < len(want) and rows(setsim.lsh_pairs(df, 0.1, hashes=hashes, bands=bands)) == want


def test_blocks_are_not_sent_to_every_other(spark):
    sets = some(6)
    packed, _ = blocks.packed(table(spark, [(k, m) for k, s in sets.items() for m in s], SCHEMA))
    found = blocks.counted(packed, 9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "codes" not in plan and "Generate" not in plan
    assert len(rows(found)) == sum(bool(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2))
