import random

import pytest

from rillstone.llm import mixing

from ..conftest import rows, table

S, T = "doc_id long, source string, tokens long", "source string, target_share double, max_repeats int"


def test_flight_keeps_totals_and_leaves_two_open():
    rng = random.Random(1)
    tokens, p = [float(rng.randrange(1, 500)) for _ in range(400)], [rng.random() for _ in range(400)]
    out = mixing.flight(tokens, p, random.Random(2))
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(sum(p)) and sum(t * x for t, x in zip(tokens, out)) == pytest.approx(sum(t * x for t, x in zip(tokens, p)))
    landed = mixing.land(tokens, out, random.Random(3))
    assert set(landed) <= {0.0, 1.0} and abs(sum(landed) - sum(p)) <= 1


def test_flight_keeps_each_chance_on_average():
    tokens, p = [10.0, 20.0, 30.0, 40.0, 25.0], [0.2, 0.5, 0.7, 0.4, 0.9]
    runs = 4000
    sums = [0.0] * 5
    for s in range(runs):
        rng = random.Random(s)
        for i, x in enumerate(mixing.land(tokens, mixing.flight(tokens, p, rng), rng)):
            sums[i] += x
    assert [x / runs for x in sums] == pytest.approx(p, abs=0.04)


def test_equal_sizes_and_settled_chances():
    assert mixing.flight([5.0] * 4, [0.0, 1.0, 0.5, 0.5], random.Random(0))[:2] == [0.0, 1.0]
    out = mixing.land([5.0] * 10, mixing.flight([5.0] * 10, [0.3] * 10, random.Random(0)), random.Random(0))
    assert sum(out) == 3


@pytest.mark.parametrize("block", [7, 5000])
def test_cube_sample_in_blocks_balances(spark, block):
    rng = random.Random(4)
    data = [(i, "a" if i % 3 else "b", rng.randrange(1, 100), 0.3 if i % 3 else 0.6) for i in range(300)]
    df = table(spark, data, S + ", chance double")
    got = {i: t for i, _, t in rows(mixing.cube_sample(df, block=block))}
    assert sorted(got) == list(range(300)) and got == {i: t for i, _, t in rows(mixing.cube_sample(df.repartition(5), block=block))}
    for source in "ab":
        mine = [r for r in data if r[1] == source]
        assert abs(sum(got[r[0]] for r in mine) - sum(r[3] for r in mine)) <= 2
        assert abs(sum(got[r[0]] * r[2] for r in mine) - sum(r[3] * r[2] for r in mine)) <= 200


def sizes(spark):
    data = [(i, " Big", 10) for i in range(100)] + [(200 + i, "small", 5) for i in range(10)] + [(300, None, 150), (301, "", 0), (302, "other", 50)]
    return table(spark, data, S)


def targets(spark):
    return table(spark, [("BIG ", 0.3, 1), ("small", 0.1, 3), ("Small ", 0.0, 2), ("absent", 0.2, 4), (None, 0.1, 1), ("zero", None, None)], T)


def test_plan(spark):
    got = {r.source: r for r in mixing.mix_plan(sizes(spark), targets(spark)).collect()}
    assert {k: r.can_reach for k, r in got.items()} == {"big": True, "small": True, "absent": False, "zero": True}
    assert got["big"].wanted == pytest.approx(375) and got["small"].rate == pytest.approx(2.5) and got["absent"].rate == 0


def test_mix_meets_targets_and_caps(spark):
    plan = mixing.mix_plan(sizes(spark), targets(spark))
    mixed = mixing.mix(sizes(spark), plan, block=20)
    got = rows(mixed)
    assert len({r[0] for r in got}) == len(got) and all(1 <= c <= (1 if s == "big" else 3) for _, s, _, c in got)
    report = {r.source: r for r in mixing.mix_report(mixed, plan).collect()}
    assert report["big"].reached_share == pytest.approx(0.3, abs=0.02) and report["small"].reached_share == pytest.approx(0.1, abs=0.01)
    assert report["absent"].tokens == 0 and sum(r.share_of_mix for r in report.values()) == pytest.approx(1.0, abs=1e-5)


def test_source_below_its_share_is_repeated_to_the_cap(spark):
    data = table(spark, [(1, "a", 10), (2, "b", 90)], S)
    plan = mixing.mix_plan(data, table(spark, [("a", 0.5, 2), ("b", 0.5, 1)], T))
    assert rows(mixing.mix(data, plan), "doc_id", "copies")[0] == (1, 2)
    assert {r.source for r in plan.where("NOT can_reach").collect()} == {"a"}


def test_the_mix_shows_which_sources_fall_short(spark):
    data = [(i, "a", 10) for i in range(20)] + [(100 + i, "b", 50) for i in range(40)] + [(200, "empty", 0), (300, "exact", 100)]
    goal = [("a", 0.5, 2), ("b", 0.3, 1), ("empty", 0.05, 9), ("none", 0.05, 1), ("zero", 0.0, 1), ("exact", 100 / 2300, 1)]
    df = table(spark, data, S)
    plan = mixing.mix_plan(df, table(spark, goal, T))
    report = mixing.mix_report(mixing.mix(df, plan, block=7), plan)
    short = {r.source for r in report.where("exhausted AND falls_short").collect()}
    assert short == {r.source for r in plan.where("NOT can_reach").collect()} == {"a", "empty", "none"}


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world, it's 42!", None, "", "äöü 👍", "a" * 50_000, "<|endoftext|>"]
    df = table(spark, [(i, t, 5) for i, t in enumerate(texts)], "doc_id int, text string, n int")
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert rows(mixing.token_counts(df, "doc_id", "n")) == [(i, 5, len(t.encode(x, add_special_tokens=False).ids) if x else 0) for i, x in enumerate(texts)]
    with pytest.raises(ValueError):
        mixing.token_counts(df, "text")


def test_empty(spark):
    none = table(spark, [], S)
    plan = mixing.mix_plan(none, targets(spark))
    assert rows(mixing.mix(none, plan)) == [] and len(rows(mixing.mix_report(mixing.mix(none, plan), plan))) == 4
    assert rows(mixing.mix_plan(none, table(spark, [], T))) == []
