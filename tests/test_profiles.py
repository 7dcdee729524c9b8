import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rillstone import catalog
from rillstone.functions.similarity import binary_cosine, containment, positional_cosine
from rillstone.functions.text import all_terms, content_terms
from rillstone.operators import profiles

from .conftest import rows, table
from .oracle import DATA


def terms(spark, text, stop=()):
    return table(spark, [(text,)], "t string").select(content_terms("t", list(stop)).alias("w")).first().w


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a1b,c", []),
        ("ab1cd,efg", ["abcd", "efg"]),
        ("The Cat sat\nnow", ["the", "cat", "sat", "now"]),
        ("it's well-known (very) №five $5.00 a|b<c>", ["well", "known", "very", "five", "a|b<c>"]),
        ("ÉTÉ straße 👍👍👍", ["été", "straße", "👍👍👍"]),
        ("one\u00a0two\u2003six\x85ten\x1cfar", ["one", "two", "six", "ten\x1cfar"]),
        ("", []),
        (None, []),
    ],
)
def test_terms(spark, text, want):
    assert terms(spark, text) == want


def test_stop_words_and_long_text(spark):
    assert terms(spark, "the cat the dog", ["the"]) == ["cat", "dog"]
    assert len(terms(spark, "word " * 200_000)) == 200_000


def docs(spark, pairs):
    return table(spark, pairs, "item string, text string")


def test_counts_and_tfidf(spark):
    texts = docs(spark, [("a", "cat cat dog"), ("a", "cat"), ("b", "dog bird"), ("c", "12 !!"), (None, "cat"), ("d", None)])
    tf = profiles.term_freq(profiles.tokens(texts))
    counts, dfs = profiles.doc_word_counts(tf, texts), profiles.doc_freq(tf)
    assert rows(tf) == [("a", "cat", 3), ("a", "dog", 1), ("b", "bird", 1), ("b", "dog", 1)]
    assert rows(counts) == [("a", 4), ("b", 2), ("c", 0), ("d", 0)]
    assert rows(dfs) == [("bird", 1), ("cat", 1), ("dog", 2)]
    assert rows(profiles.frequent_words(dfs, counts, 2 / 6)) == [("dog", 2)]
    score = {(i, w): s for i, w, s in rows(profiles.tfidf(tf, counts, dfs))}
    assert score["a", "cat"] == round(3 / 4 * math.log2(4), 9) and score["b", "dog"] == round(1 / 2 * math.log2(2), 9)
    smooth = {(i, w): s for i, w, s in rows(profiles.tfidf_smoothed(tf, counts, dfs))}
    assert smooth["a", "dog"] == round(1 / 4 * math.log(4 / 3), 9)


def test_top_words_ties(spark):
    scores = table(spark, [("a", w, 1.0) for w in ("c", "b", "a")], "item string, word string, score double")
    assert [w for _, w, _ in rows(profiles.top_words(scores, 2))] == ["a", "b"]


def test_user_words_both_modes(spark):
    prof = table(spark, [("i", w, s) for w, s in (("great", 0.1), ("food", 0.2), ("good", 0.3), ("xyz", 0.4), ("azz", 0.5))], "item string, word string, score double")
    reviews = table(spark, [("u", "i", 1.0), (None, "i", 1.0), ("v", "none", 1.0)], "user string, item string, stars double")
    assert [w for _, w in rows(profiles.user_words(reviews, prof, "compat", 3))] == ["azz", "great", "xyz"]
    assert [w for _, w in rows(profiles.user_words(reviews, prof, "intended", 2))] == ["azz", "xyz"]
    twice = table(spark, [("u", "i", 1.0), ("u", "i", 2.0)], "user string, item string, stars double")
    assert [w for _, w in rows(profiles.user_words(twice, prof, "compat", 3))] == ["azz", "xyz"]
    with pytest.raises(ValueError):
        profiles.user_words(reviews, prof, "other")


def test_kernels(spark):
    df = table(spark, [(["a", "b"], ["b", "c", "d", "e"]), ([], ["x"])], "u array<string>, v array<string>")
    got = [tuple(r) for r in df.select(binary_cosine(F.col("u"), F.col("v")), containment(F.col("u"), F.col("v"))).collect()]
    assert got[0] == (pytest.approx(1 / math.sqrt(8)), 0.5) and got[1] == (0.0, 0.0)
    pad = table(spark, [([1.0, 2.0], [2.0]), ([0.0], [1.0])], "u array<double>, v array<double>")
    got = [r[0] for r in pad.select(positional_cosine(F.col("u"), F.col("v"))).collect()]
    assert got == [pytest.approx(1 / math.sqrt(5)), 0.0]


def test_scores_of_test_pairs(spark):
    users = table(spark, [("u", ["a", "b"])], "id string, words array<string>")
    items = table(spark, [("i", ["a", "b"]), ("j", ["z"])], "id string, words array<string>")
    test = table(spark, [("u", "i", 2), ("u", "j", 1), ("x", "i", 1)], "user string, item string, times long")
    assert rows(profiles.score_pairs(test, users, items)) == [("u", "i", 1.0)] * 2


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_merged_pairs_item_wins(spark, block):
    users = table(spark, [("u", ["a", "b"]), ("both", ["a", "b"]), ("v", ["b"]), ("none", []), (None, ["a"])], "id string, words array<string>")
    items = table(spark, [("i", ["a", "b"]), ("both", ["x", "y"]), ("j", ["b", "c", "d", "e"])], "id string, words array<string>")
    got = rows(profiles.merged_pairs(users, items, 0.4, block))
    assert got == [("u", "i", 1.0), ("v", "i", round(1 / math.sqrt(2), 6)), ("v", "j", 0.5)]
    assert rows(profiles.merged_pairs(users.where("false"), items)) == [] == rows(profiles.merged_pairs(users, items.where("false")))


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_merged_pairs_of_whole_profiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(profiles, "MOST_ENTRIES", 2_000)
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = f"WITH {catalog.USERS}, {catalog.TEST}, {catalog.MERGED} SELECT key, is_item, list(member) FROM inc GROUP BY ALL"
    found = db.sql(sql).fetchall()
    users, items = ({k: set(w) for k, i, w in found if i == side} for side in (False, True))
    assert max(map(len, items.values())) == profiles.PROFILE_WORDS
    want = {(a, b): round(len(users[a] & items[b]) / math.sqrt(len(users[a]) * len(items[b])), 6) for a in users for b in items}
    want = {k: sim for k, sim in want.items() if sim >= 0.01}
    found = rows(catalog.QUERIES["merged_profile_pairs"](spark, str(DATA)), "user", "item", "sim")
    got = {(a, b): sim for a, b, sim in found}
    assert len(found) == len(got) and got.keys() == want.keys()
    assert all(sim == pytest.approx(want[k], abs=1e-6) for k, sim in got.items())


def test_profiles_are_not_sent_to_every_block_of_the_other_side(spark):
    users = table(spark, [(f"u{i}", ["a", f"w{i}"]) for i in range(9)], "id string, words array<string>")
    items = table(spark, [(f"i{i}", ["a", f"w{i}"]) for i in range(9)], "id string, words array<string>")
    found = profiles.merged_pairs(users, items, block=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "words" not in plan and "FlatMapCoGroups" not in plan
    assert {(u, i): s for u, i, s in rows(found)} == {(f"u{i}", f"i{j}"): 1.0 if i == j else 0.5 for i in range(9) for j in range(9)}


def test_words_of_reviews_do_not_move(spark):
    prof = table(spark, [("i", "great", 0.1)], "item string, word string, score double")
    plan = profiles.user_words(table(spark, [("u", "i")], "user string, item string"), prof)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize(("entries", "dense"), [(5_000_000, 4_096), (7, 4_096), (7, 0)])
@pytest.mark.parametrize("mode", ["intended", "compat"])
def test_profiles_in_parts_equal_brute_force(spark, monkeypatch, entries, dense, mode):
    for name, value in (("MOST_ENTRIES", entries), ("REVIEW_WORDS", entries), ("DENSE_WORDS", dense), ("ITEMS_PER_PART", 3), ("REVIEWS_PER_TASK", 20), ("USERS_AT_ONCE", 2), ("ROWS_AT_ONCE", 3)):
        monkeypatch.setattr(profiles, name, value)
    rng = random.Random(3)
    prof = {f"i{i}": {f"w{rng.randrange(30)}x": rng.randrange(10**6) / 1e9 for _ in range(6)} for i in range(12)}
    reviews = [(f"u{rng.randrange(9)}", f"i{rng.randrange(14)}") for _ in range(60)]
    want = set()
    for u in {u for u, _ in reviews}:
        total = {}
        for _, i in [r for r in reviews if r[0] == u and r[1] in prof]:
            for w, s in prof[i].items():
                total.setdefault(w, []).append(round(s * 1e9))
        if mode == "intended":
            want |= {(u, w) for w in sorted(total, key=lambda w: (-((sum(total[w]) + 500) // 1000), w))[:5]}
        else:
            again = [w for w in sorted(total, key=lambda w: (-ord(w[1]), w)) for _ in total[w]]
            want |= {(u, w) for w in again[:5]}
    scores = table(spark, [(i, w, s) for i, ws in prof.items() for w, s in ws.items()], "item string, word string, score double")
    found = profiles.user_words(table(spark, reviews, "user string, item string"), scores, mode, 5)
    assert len(want) > 25 and rows(found) == sorted(want)
    users, items = (d.groupBy(F.col(k).alias("id")).agg(F.collect_set("word").alias("words")) for d, k in ((found, "user"), (scores, "item")))
    words = {u: {w for v, w in want if v == u} for u, _ in want}
    cosine = {(u, i): round(len(words[u] & ws.keys()) / math.sqrt(len(words[u]) * len(ws)), 6) for u in words for i, ws in prof.items()}
    assert {(u, i): s for u, i, s in rows(profiles.merged_pairs(users, items, block=4))} == {k: pytest.approx(s, abs=1e-6) for k, s in cosine.items() if s}


def test_map_argmax(spark):
    df = table(spark, [({"a": {"x": 1, "y": 5}, "b": {"x": 5}, "c": {}},)], "m map<string,map<string,int>>")
    assert rows(profiles.map_argmax(df, "m")) == [("a", "y", 5)]
    assert rows(profiles.map_argmax(table(spark, [({},)], "m map<string,map<string,int>>"), "m")) == []


def test_empty(spark):
    texts = docs(spark, [])
    tf = profiles.term_freq(profiles.tokens(texts))
    counts = profiles.doc_word_counts(tf, texts)
    assert rows(profiles.tfidf(tf, counts, profiles.frequent_words(profiles.doc_freq(tf), counts))) == []
    assert rows(table(spark, [], "t string").select(all_terms("t"))) == []
