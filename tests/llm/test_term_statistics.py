import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.functions.text import all_terms
from rillstone.llm import distinctive, term_frequency, terms, top_terms

from rillstone.plans.spread import split

from ..conftest import rows, table

TEXTS = ["the cat and the dog", "The DOG; cat_cat", None, "", "12 a1b!", "été №été", "dog " * 3000, "the cat and the dog"]


def test_words_equal_the_expression(spark):
    texts = [*TEXTS, "a bcd efg\x85hij​klm", "İstanbul ΣΑΣ'ΑΣ Σ", "x" * 100_000, "abc\x0bdef$5 <b>ghi</b>"]
    df = table(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, words in df.select("i", all_terms("t")).collect():
        assert words == terms.words_of(texts[i])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abé1 ,.\n", max_size=30)), max_size=8))
def test_a_run_counts_its_block(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    (run,) = terms.sorted_runs("text")(iter([batch]))
    got = {r["term"]: (r["records"], r["occurrences"]) for r in run.to_pylist()}
    occurrences = Counter(w for t in texts for w in terms.words_of(t))
    records = Counter(w for t in texts for w in set(terms.words_of(t)))
    assert got.pop(None) == (len(texts), sum(occurrences.values()))
    assert got == {w: (records[w], n) for w, n in occurrences.items()}
    order = [r["term"] for r in run.to_pylist()][1:]
    assert order == sorted(order)


def test_merging_runs_across_batches():
    def batch(*found):
        return pa.RecordBatch.from_arrays([pa.array([t for t, *_ in found], pa.string()), *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)]], ["term", "records", "occurrences"])

    got = [tuple(r.values()) for b in terms.merge_runs(iter([batch(("a", 1, 2), ("a", 1, 1)), batch(), batch(("a", 3, 3), ("b", 1, 1)), batch(("c", 1, 4))])) for r in b.to_pylist()]
    assert got == [("a", 5, 6), ("b", 1, 1), ("c", 1, 4)]


def test_frequencies_equal_brute_force(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = table(spark, [(t, "clash") for t in TEXTS] + [("odd", "x")], "text string, term string").repartition(3)
        got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequency.term_frequencies(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    every = [*TEXTS, "odd"]
    occurrences = Counter(w for t in every for w in terms.words_of(t))
    records = Counter(w for t in every for w in set(terms.words_of(t)))
    assert got == {w: (n, records[w], "common" if records[w] * 10 >= len(every) else "rare" if records[w] <= 2 else None) for w, n in occurrences.items()}


def test_marks_at_the_limits(spark):
    df = table(spark, [("common two",)] * 2 + [("common one",)] + [("",)] * 26 + [(None,)], "text string")
    got = {r.term: r.mark for r in term_frequency.term_frequencies(df).collect()}
    assert got == {"common": "common", "two": "rare", "one": "rare"}


def test_no_records(spark):
    assert rows(term_frequency.term_frequencies(table(spark, [], "text string"))) == []


def grouped(spark, data, by, shard_rows):
    df = table(spark, data, "kind string, gid string, record string, text string, n int, shard int")
    return {(k, g, t): n for k, g, t, n in rows(terms.grouped_counts(df, ["the"], by, shard_rows))}


@pytest.mark.parametrize("by", ["records", "occurrences"])
@pytest.mark.parametrize("shard_rows", [3, 20_000])
def test_grouped_counts_equal_brute_force(spark, by, shard_rows):
    data = [("b", "hot", f"r{i % 40}", f"the word{i % 40 % 7} same same", 1, 2) for i in range(60)]
    data += [("u", f"g{i % 5}", f"s{i}", TEXTS[i % 6], 1, 2) for i in range(12)]
    data += [(None, "g", "r", "none", 1, 1), ("b", None, "r", "none", 1, 1), ("b", "g", None, "none", 1, 1), ("b", "silent", "r", None, 1, 1)]
    want, seen = defaultdict(int), set()
    for kind, gid, record, text, *_ in data:
        if None in (kind, gid, record) or (kind, gid, record) in seen:
            continue
        seen.add((kind, gid, record))
        words = [w for w in terms.words_of(text) if w != "the"]
        for w in set(words) if by == "records" else words:
            want[kind, gid, w] += 1
    assert grouped(spark, data, by, shard_rows) == want


def test_records_of_several_groups_and_every_large_group_in_shards(spark, monkeypatch):
    split_by = []
    monkeypatch.setattr(terms, "split", lambda df, by, hot, *c: split_by.append({r.gid: r["__parts"] for r in hot.collect()}) or split(df, by, hot, *c))
    data = [(f"r{i}", f"cat{'xyz'[i % 3]} dog", [("b", f"g{i % 3}"), ("u", f"x{i}"), ("u", None)]) for i in range(90)]
    df = table(spark, data, "record string, text string, groups array<struct<kind:string,gid:string>>")
    got = {(k, g, t): n for k, g, t, n in rows(terms.grouped_counts(df, [], "records", 20))}
    assert got == {("b", f"g{i}", w): 30 for i in range(3) for w in ("dog", f"cat{'xyz'[i]}")} | {("u", f"x{i}", w): 1 for i in range(90) for w in ("dog", f"cat{'xyz'[i % 3]}")}
    assert split_by == [{f"g{i}": 2 for i in range(3)}]


def test_grouped_counts_of_nothing(spark):
    assert grouped(spark, [], "records", 5) == {}
    with pytest.raises(ValueError):
        grouped(spark, [], "other", 5)


def test_top_n_ties_nulls_and_clashing_names(spark):
    data = [("g", 2, "b", 0), ("g", 2, "a", 0), ("g", 3, "c", 0), ("g", None, "0", 0), ("h", None, "x", 0)]
    df = table(spark, data, "g string, score int, id string, rank int")
    assert rows(top_terms.top_n(df, ["g"], "score", "id", 2), "g", "id", "rank") == [("g", "a", 0), ("g", "c", 0), ("h", "x", 0)]
    assert rows(top_terms.top_n(df.limit(0), ["g"], "score", "id", 2)) == []


def test_top_n_is_limited_before_the_shuffle(spark):
    df = table(spark, [("g", 1, "a")], "g string, score int, id string")
    plan = top_terms.top_n(df, ["g"], "score", "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_z_scores_equal_brute_force(spark):
    data = [("x", "pizza", 5), ("x", "good", 5), ("y", "good", 7), ("y", "wine", 2), ("z", "good", 1)]
    got = {(g, t): (k, n, d, z) for g, t, k, n, d, z in rows(distinctive.distinctive_terms(table(spark, data, "gid string, term string, n long"), 10.0))}
    total, of_term, of_group = 20, Counter(), Counter()
    for g, t, k in data:
        of_term[t] += k
        of_group[g] += k
    for g, t, k in data:
        prior, rest, n = 10 * of_term[t] / total, of_term[t] - k, of_group[g]
        gap = math.log((k + prior) / (n + 10 - k - prior)) - math.log((rest + prior) / (total - n + 10 - rest - prior))
        z = gap / math.sqrt(1 / (k + prior) + 1 / (rest + prior))
        assert got[g, t] == (k, n, sum(t == u for _, u, _ in data), pytest.approx(z))
    assert got["x", "pizza"][3] > got["x", "good"][3]


def test_scores_of_one_term_and_of_none(spark):
    one = rows(distinctive.distinctive_terms(table(spark, [("x", "only", 3)], "gid string, term string, n long")))
    assert len(one) == 1 and math.isfinite(one[0][5])
    assert rows(distinctive.distinctive_terms(table(spark, [], "gid string, term string, n long"))) == []
