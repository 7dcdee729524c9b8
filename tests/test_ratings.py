import random

import pytest

from rillstone.operators import predict, ratings

from .conftest import rows, table

R = "user string, item string, stars double"
T = "user string, item string, times long"
A = "user string, avg_stars double"


def grid(values):
    return [(u, i, float(s)) for (u, i), s in values.items()]


def test_means_ignore_null_stars(spark):
    df = table(spark, [("u", "i", 1.0), ("u", "i", 4.0), ("u", "i", None), ("v", "i", None)], R)
    assert rows(ratings.rating_means(df)) == [("u", "i", 2.5)]


def test_pearson_known_and_constant(spark):
    r = [("u1", "a", 1), ("u2", "a", 2), ("u3", "a", 3), ("u1", "b", 2), ("u2", "b", 4), ("u3", "b", 6), ("u1", "c", 3), ("u2", "c", 3), ("u3", "c", 3)]
    df = table(spark, [(u, i, float(s)) for u, i, s in r], R)
    got = {(a, b): s for a, b, _, _, s in rows(ratings.pearson_pairs(df, "item"))}
    assert got == {("a", "b"): pytest.approx(1.0), ("a", "c"): 0.0, ("b", "c"): 0.0}
    assert rows(ratings.item_weights(df)) == [("a", "b", 1.0), ("b", "a", 1.0)]


def test_support_of_three(spark):
    df = table(spark, [(u, i, 1.0) for u in ("x", "y") for i in "ab"] + [("z", "a", 2.0)], R)
    assert rows(ratings.pearson_pairs(df, "user")) == [] and rows(ratings.pearson_pairs(df, "item")) == []


def test_least_jaccard_of_users(spark):
    r = [("x", f"i{k}", float(k % 5)) for k in range(200)] + [("y", f"i{k}", float(k % 3)) for k in range(197, 397)]
    df = table(spark, r, R)
    assert rows(ratings.user_weights(df)) == []
    assert len(rows(ratings.pearson_pairs(df, "user"))) == 1


def test_item_based_rules(spark):
    df = table(spark, [("u", "a", 2.0), ("u", "b", 4.0), ("u", "c", 5.0)], R)
    w = table(spark, [("t", "a", 0.5), ("a", "t", 0.5), ("t", "b", 0.25), ("b", "t", 0.25), ("t", "c", 0.125), ("c", "t", 0.125)], "b1 string, b2 string, sim double")
    test = table(spark, [("u", "t", 2), ("unseen", "t", 1), ("u", "other", 1)], T)
    want = round((2 * 0.5 + 4 * 0.25) / 0.75, 6)
    assert rows(predict.predict_item_based(df, w, test)) == [("u", "t", want)] * 2


def test_zero_weights_rank_above_negative_ones(spark):
    df = table(spark, [("v1", "t", 1.0), ("v2", "t", 2.0), ("v3", "t", 5.0), ("u", "x", 3.0)], R)
    w = table(spark, [("u", "v3", -0.5)], "u1 string, u2 string, sim double")
    avg = table(spark, [(x, 3.0) for x in ("u", "v1", "v2", "v3")], A)
    assert rows(predict.predict_user_based(df, w, avg, table(spark, [("u", "t", 1)], T))) == [("u", "t", 3.0)]


def test_repeated_reviews_take_a_place_each(spark):
    df = table(spark, [("v1", "t", 1.0), ("v1", "t", 3.0), ("v2", "t", 5.0)], R)
    w = table(spark, [("u", "v1", 0.5), ("u", "v2", 0.25)], "u1 string, u2 string, sim double")
    avg = table(spark, [("u", 3.0), ("v1", 1.0), ("v2", 1.0)], A)
    assert rows(predict.predict_user_based(df, w, avg, table(spark, [("u", "t", 1)], T))) == [("u", "t", 4.0)]


def test_first_raters_give_the_same_as_all(spark):
    rng = random.Random(1)
    df = table(spark, [(f"v{rng.randrange(12):02d}", f"t{rng.randrange(4)}", float(rng.randrange(1, 6))) for _ in range(60)], R)
    pairs = {(a, b): rng.choice([-0.5, 0.0, 0.25, 0.5]) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.7}
    w = table(spark, [(f"v{a:02d}", f"v{b:02d}", s) for (a, b), s in pairs.items()], "u1 string, u2 string, sim double")
    avg = table(spark, [(f"v{i:02d}", 2.0 + i / 7) for i in range(12) if i != 5], A)
    test = table(spark, [(f"v{u:02d}", f"t{i}", 1) for u in range(12) for i in range(4)], T)
    every = rows(predict.predict_user_based(df, w, avg, test, 3))
    for first in (3, 5):
        assert rows(predict.predict_user_based(df, w, avg, test, 3, first)) == every


def test_negative_item_weights_come_after_unstored_ones(spark):
    df = table(spark, [("u", "a", 2.0), ("u", "b", 4.0), ("u", "c", 5.0)], R)
    w = table(spark, [("t", "a", 0.5), ("t", "b", -0.5)], "b1 string, b2 string, sim double")
    test = table(spark, [("u", "t", 1)], T)
    assert rows(predict.predict_item_based(df, w, test, 2)) == [("u", "t", 2.0)]
    assert rows(predict.predict_item_based(df, w, test, 3)) == [("u", "t", -1.0)]


def test_user_based_null_rules(spark):
    df = table(spark, [("v", "t", 4.0)], R)
    w = table(spark, [("u", "v", 0.5)], "u1 string, u2 string, sim double")
    test = table(spark, [("u", "t", 1), ("u", "unseen", 1), ("noavg", "t", 1)], T)
    got = rows(predict.predict_user_based(df, w, table(spark, [("u", 3.0)], A), test))
    assert got == [("noavg", "t", None), ("u", "t", None), ("u", "unseen", None)]
    got = rows(predict.predict_user_average(df, table(spark, [("u", 3.0)], A), test))
    assert got == [("noavg", "t", None), ("u", "t", 3.0), ("u", "unseen", None)]


def test_empty_tables(spark):
    df, test = table(spark, [], R), table(spark, [], T)
    assert rows(ratings.item_weights(df)) == rows(ratings.user_weights(df)) == []
    assert rows(predict.predict_item_based(df, ratings.item_weights(df), test)) == []
    assert rows(predict.predict_user_based(df, ratings.user_weights(df), table(spark, [], A), test)) == []


@pytest.mark.parametrize("both", [False, True])
def test_item_based_takes_the_first_places_of_many_neighbours(spark, both):
    rng = random.Random(7)
    items = [f"i{k}" for k in range(30)]
    stars = [(u, i, float(rng.randrange(1, 6))) for u in ("hot", "u1", "u2", "u3") for i in items if u == "hot" or rng.random() < 0.2 for _ in range(rng.randrange(1, 3))]
    weight = {(a, b): rng.choice([-0.5, 0.25, 0.5, 0.75]) for a in items for b in items if a < b and rng.random() < 0.5}
    stored = [(a, b, s) for (a, b), s in weight.items()] + [(b, a, s) for (a, b), s in weight.items() if both]
    test = [(u, i, 1) for u in ("hot", "u1", "u2", "u3", "unseen") for i in items]
    want = []
    for u, t, _ in test:
        ranked = sorted((-weight.get((min(t, i), max(t, i)), 0.0), i) for v, i, _ in stars if v == u)[:2]
        under = sum(abs(w) for w, _ in ranked)
        mean = lambda i: sum(s for v, j, s in stars if (v, j) == (u, i)) / sum((v, j) == (u, i) for v, j, _ in stars)
        if under:
            want.append((u, t, pytest.approx(sum(mean(i) * -w for w, i in ranked) / under, abs=2e-6)))
    got = predict.predict_item_based(table(spark, stars, R), table(spark, stored, "b1 string, b2 string, sim double"), table(spark, test, T), both=both)
    assert rows(got) == sorted(want, key=lambda r: r[:2]) and len(want) > 30
    # The reviews of a hot user meet neither its pairs nor the weights in a join.
    assert sum("w#" in x.split("[")[-1] for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x) == 0
