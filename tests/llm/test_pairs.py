import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from rillstone.llm import cooccurrence, similar_sets

from ..conftest import rows, table

SCHEMA = "key string, member string"


def sets_of(pairs):
    sets = defaultdict(set)
    for k, m in pairs:
        if k is not None and m is not None:
            sets[k].add(m)
    return sets


def brute_similar(pairs, threshold, least=3):
    s = {k: v for k, v in sets_of(pairs).items() if len(v) >= least}
    return {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def audiences(seed, keys=150, hot=3):
    """Sets with a few members that nearly all share, near copies, exact copies, and one very large set."""
    rng = random.Random(seed)
    pairs = []
    for i in range(keys):
        base = [f"u{rng.randrange(300)}" for _ in range(rng.randrange(3, 12))] + [f"hot{h}" for h in range(hot) if rng.random() < 0.8]
        pairs += [(f"k{i}", m) for m in base]
        if i % 4 == 0:
            pairs += [(f"near{i}", m) for m in base if rng.random() < 0.85]
        if i % 10 == 0:
            pairs += [(f"copy{i}", m) for m in base]
    pairs += [("large", f"u{i}") for i in range(300)]
    return pairs


@pytest.mark.parametrize("leaf", [100, 8])
def test_all_similar_sets_are_found(spark, leaf):
    pairs = audiences(1)
    df = table(spark, [(*p, "x", 1) for p in pairs] + [("k0", None, "x", 1), (None, "u1", "x", 1)], SCHEMA + ", n string, id int")
    found, members = similar_sets.similar_sets(df, leaf=leaf)
    got = rows(similar_sets.expanded(found, members), "k1", "k2")
    want = brute_similar(pairs, 0.5)
    assert len(want) > 50 and len(got) == len(set(got))
    assert set(got) <= want and len(want - set(got)) <= 0.005 * len(want)


def test_nodes_that_never_split_are_compared_in_blocks(spark):
    pairs = [(f"k{i:02d}", m) for i in range(40) for m in ("a", "b", "c", "d", f"own{i}")]
    found, members = similar_sets.similar_sets(table(spark, pairs, SCHEMA), leaf=5, depth=3)
    assert set(rows(similar_sets.expanded(found, members), "k1", "k2")) == brute_similar(pairs, 0.5)


@pytest.mark.parametrize(("shared", "own"), [("ab", 1), ("abc", 1), ("abcd", 1), ("abcd", 2), ("abcdef", 3)])
def test_pairs_that_share_only_hot_members_are_found(spark, shared, own):
    """More records than a node may hold at the default leaf and depth, similar by the tokens of the path alone."""
    pairs = [(f"k{i:03d}", m) for i in range(130) for m in (*shared, *(f"own{i}-{j}" for j in range(own)))]
    pairs += [("plain", m) for m in (*shared, "x")] + [("wide", m) for m in (*shared, *(f"w{j}" for j in range(len(shared))))]
    found, members = similar_sets.similar_sets(table(spark, pairs, SCHEMA))
    got, want = rows(similar_sets.expanded(found, members), "k1", "k2"), brute_similar(pairs, 0.5)
    assert len(got) == len(set(got)) and len(want) > 130 * 129 / 2 and set(got) == want


def test_copies_are_one_class(spark):
    pairs = [(k, m) for k in ("a", "b", "c") for m in "xyz"]
    found, members = similar_sets.similar_sets(table(spark, pairs, SCHEMA))
    assert len(rows(found)) == 1 and len({i for _, i in rows(members)}) == 1
    assert rows(similar_sets.expanded(found, members), "k1", "k2") == [("a", "b"), ("a", "c"), ("b", "c")]


def test_threshold_is_met_exactly_and_small_sets_are_out(spark):
    pairs = [("a", m) for m in "123"] + [("b", m) for m in "234"] + [("c", m) for m in "12"] + [("d", m) for m in "12"]
    found, members = similar_sets.similar_sets(table(spark, pairs, SCHEMA))
    assert rows(similar_sets.expanded(found, members)) == [("a", "b", 0.5)]
    with pytest.raises(ValueError):
        similar_sets.similar_sets(table(spark, pairs, SCHEMA), threshold=0.0)


@pytest.mark.parametrize("threshold", [0.2, 0.35])
def test_lower_thresholds_follow_more_tokens(spark, threshold):
    pairs = audiences(4, 120)
    found, members = similar_sets.similar_sets(table(spark, pairs, SCHEMA), threshold, leaf=20)
    got, want = set(rows(similar_sets.expanded(found, members), "k1", "k2")), brute_similar(pairs, threshold)
    assert got <= want and len(want) > 100 and len(want - got) <= 0.005 * len(want)


def test_sketch_filter_misses_as_rarely_as_stated():
    assert [similar_sets.least_equal(t) for t in (0.2, 0.5, 0.8, 1.0)] == [0, 5, 15, 32]


def test_two_tables(spark):
    left = [("a", m) for m in "1234"] + [("a2", m) for m in "1234"]
    right = [("a", m) for m in "1234"] + [("b", m) for m in "2345"] + [("c", m) for m in "789"]
    found, members = similar_sets.similar_sets(table(spark, left, SCHEMA), other=table(spark, right, SCHEMA))
    by_id = defaultdict(lambda: defaultdict(set))
    for side, key, i in rows(members, "side", "key", "id"):
        by_id[i][side].add(key)
    got = {(x, y) for a, b, _ in rows(found, "a", "b", "sim") for p, q in {(a, b), (b, a)} for x in by_id[p][1] for y in by_id[q][2]}
    assert got == {("a", "a"), ("a2", "a"), ("a", "b"), ("a2", "b")}


def test_no_sets(spark):
    found, members = similar_sets.similar_sets(table(spark, [], SCHEMA))
    assert rows(found) == [] and rows(members) == []


def brute_counts(pairs, least):
    s = sets_of(pairs)
    return {(a, b, len(s[a] & s[b]), len(s[a]), len(s[b])) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) >= least}


@pytest.mark.parametrize(("heavy", "most"), [(64, 256), (5, 256), (5, 3), (0, 256)])
def test_pair_counts_equal_brute_force(spark, monkeypatch, heavy, most):
    """Heavy baskets down to every basket, and more of them than there are bits for."""
    monkeypatch.setattr(cooccurrence, "HEAVY_BASKET", heavy)
    monkeypatch.setattr(cooccurrence, "MOST_HEAVY", most if most == 256 else 64)
    rng = random.Random(heavy)
    pairs = [(f"i{rng.randrange(40)}", f"b{int(rng.paretovariate(0.6)) % 70}") for _ in range(1500)]
    pairs += [(f"only{i}", f"big{b}") for i in range(12) for b in range(7)]
    df = table(spark, [(*p, 1) for p in pairs] + [(None, "b1", 1), ("i1", None, 1)], SCHEMA + ", n int")
    found, items, baskets = cooccurrence.pair_counts(df, 5)
    got = rows(found, "k1", "k2", "c", "n1", "n2")
    assert len(got) == len(set(got)) and set(got) == brute_counts(pairs, 5)
    assert baskets == len({b for _, b in pairs}) and len(rows(items)) == len({i for i, _ in pairs})


@pytest.mark.parametrize("heavy", [64, 5, 0])
def test_pairs_of_a_single_common_basket(spark, monkeypatch, heavy):
    monkeypatch.setattr(cooccurrence, "HEAVY_BASKET", heavy)
    rng = random.Random(heavy)
    pairs = [(f"i{rng.randrange(60)}", f"b{int(rng.paretovariate(0.6)) % 90}") for _ in range(500)] + [(k, f"same{b}") for k in ("x", "y") for b in range(3)]
    df = table(spark, pairs, SCHEMA)
    found, items, n = cooccurrence.pair_counts(df, 1)
    assert set(rows(found, "k1", "k2", "c", "n1", "n2")) == brute_counts(pairs, 1)
    got = rows(cooccurrence.surprise(found, items, cooccurrence.basket_sizes(df), n, 1), "k1", "k2", "c", "n1", "n2")
    assert len(got) == len(set(got)) and set(got) == brute_counts(pairs, 1) and ("x", "y", 3, 3, 3) in got


def test_counts_of_nothing(spark):
    found, items, baskets = cooccurrence.pair_counts(table(spark, [], SCHEMA))
    assert rows(found) == [] and baskets == 0
    assert rows(cooccurrence.surprise(found, items, cooccurrence.basket_sizes(table(spark, [], SCHEMA)), 0)) == []


def exact_tail(p, n, c):
    pmf = np.array([1.0])
    for q, m in zip(p, n):
        for _ in range(int(m)):
            pmf = np.convolve(pmf, [1 - q, q])
    return pmf[c:].sum()


def test_null_meets_degrees_and_tails():
    items, baskets = {3: 30, 10: 12, 40: 2}, {1: 40, 2: 25, 5: 12, 20: 4}
    links = sum(d * n for d, n in items.items())
    baskets[1] += links - sum(d * n for d, n in baskets.items())
    null = cooccurrence.ConfigurationNull(list(items.items()), list(baskets.items()))
    assert (null.p @ np.array([30, 12, 2])) == pytest.approx([1, 2, 5, 20], rel=1e-4)
    assert (null.nk @ null.p) == pytest.approx([3, 10, 40], rel=1e-4)
    d1, d2, c = np.array([10, 10, 40, 40, 3]), np.array([10, 10, 40, 10, 3]), np.array([5, 9, 20, 7, 3])
    mean, tail = null.log10_tail(d1, d2, c)
    for k in range(len(c)):
        p = null.p[:, list(null.d).index(d1[k])] * null.p[:, list(null.d).index(d2[k])]
        assert mean[k] == pytest.approx((null.nk * p).sum())
        if c[k] > mean[k] + 0.5:
            assert tail[k] == pytest.approx(np.log10(exact_tail(p, null.nk, c[k])), abs=0.05)


def test_size_classes(spark):
    df = table(spark, [(d,) for d in (1, 1, 3, 512, 513, 514, 600, 10**9)], "m long")
    assert cooccurrence.degree_classes(df, "m") == [(1.0, 2), (3.0, 1), (512.0, 1), (513.5, 2), (600.0, 1), (1e9, 1)]
    assert cooccurrence.degree_classes(df.limit(0), "m") == []


def test_false_discovery_adjustment(spark):
    rng = random.Random(3)
    pairs = [(f"i{rng.randrange(30)}", f"b{rng.randrange(80)}") for _ in range(900)] + [(k, f"c{b}") for k in ("x", "y") for b in range(15)]
    df = table(spark, pairs, SCHEMA)
    found, items, n = cooccurrence.pair_counts(df, 5)
    got = cooccurrence.surprise(found, items, cooccurrence.basket_sizes(df), n).collect()
    able = sum(len(v) >= 5 for v in sets_of(pairs).values())
    tests = able * (able - 1) / 2
    ps = sorted(10**r.log10_p for r in got)
    for r in got:
        p = 10**r.log10_p
        want = min(min(q * tests / sum(x <= q * (1 + 1e-9) for x in ps) for q in ps if q >= p * (1 - 1e-9)), 1.0)
        assert r.q == pytest.approx(want, rel=1e-6)
    assert {(r.k1, r.k2) for r in got if r.surprising} >= {("x", "y")}
