import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from rillstone.llm import abuse
from rillstone.llm.ordinal import OrdinalModel, Rows, sigmoid

from ..conftest import rows, table

DATA = Path("/root/testdata/check_l")
D, L = "doc_id long, text string, source string, note string", "doc_id long, label string, annotator string"


def test_ordinal_weights_are_shared_and_ordered():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 900)
    x = [np.unique(np.r_[rng.integers(10, 60, 5), np.arange(g)]).astype(np.int32) for g in grade]
    m = OrdinalModel(64, 3).fit(Rows(x), grade, np.ones(900))
    z = Rows(x).dot(m.w)
    assert (np.diff(m.cuts) > 0).all()
    means = [m.severity(z[grade == g]).mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    x = Rows([np.unique(rng.integers(0, 8, 3)).astype(np.int32) for _ in range(40)])
    grade, w, cuts = rng.integers(0, 4, 40), rng.normal(size=8), np.array([-0.5, 0.3, 1.1])

    def loglik(w):
        b = np.r_[-np.inf, cuts, np.inf]
        z = x.dot(w)
        return np.log(sigmoid(b[grade + 1] - z) - sigmoid(b[grade] - z)).sum()

    b = np.r_[-np.inf, cuts, np.inf]
    z = x.dot(w)
    g = x.back(sigmoid(b[grade + 1] - z) + sigmoid(b[grade] - z) - 1, 8)
    for k in range(8):
        e = np.eye(8)[k] * 1e-5
        assert g[k] == pytest.approx((loglik(w + e) - loglik(w - e)) / 2e-5, abs=1e-4)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You IDIOT!", [["you", "idiot"]]),
        ("1d10t. i d i o t", [["idiot"], ["idiot"]]),
        ("m***n and sh1t", [["m*n", "and", "shit"]]),
        ("hоrny $3x", [["horny", "sex"]]),
        ("<p>One</p><p>two &amp; 42</p>", [["one"], ["two", "42"]]),
        (None, []),
        ("...", []),
    ],
)
def test_passages(text, want):
    assert abuse.passages(text) == want


def word_features(words):
    """Features of one passage, one by one."""
    code = [zlib.crc32(w.encode()) for w in words]
    found = [(b * 31 + c * 17 + 1) for b, c in zip(code, code[1:])] + [(a * 37 + c * 13 + 2) for a, c in zip(code, code[2:])]
    found += [(a * 41 + b * 29 + c * 7 + 3) for a, b, c in zip(code, code[1:], code[2:])]
    for w in words:
        padded = f"<{w}>"
        found += [zlib.crc32(("w " + w).encode())] + [zlib.crc32(f"c {padded[i : i + 4]}".encode()) for i in range(len(padded) - 3) if len(w) > 3]
    return sorted(x % abuse.FEATURES for x in found)


TEXTS = ["One. Two words! Go away, you; go away", None, "", "...", "1d10t i d i o t\x00x", "longer words here " * 30 + "\n\nend", "Ünïcode tеxt. 42"]


def test_features_of_a_batch_are_those_of_its_passages():
    got = abuse.document_features(TEXTS)
    assert [[sorted(p.tolist()) for p in doc] for doc in got] == [[word_features(p) for p in abuse.passages(t)] for t in TEXTS]
    assert abuse.document_features([]) == [] and abuse.document_features([None]) == [[]]


def test_scores_of_a_batch_are_those_of_the_rows():
    weights = np.random.default_rng(2).normal(size=abuse.FEATURES)
    lexicon = abuse.Lexicon()
    abuse.Batch(["seen before", "words"], lexicon)
    batch = abuse.Batch(TEXTS, lexicon)
    flat = [np.array(word_features(p), np.int32) for t in TEXTS for p in abuse.passages(t)]
    assert batch.scores(weights) == pytest.approx(Rows(flat).dot(weights))
    assert batch.text.tolist() == [i for i, t in enumerate(TEXTS) for _ in abuse.passages(t)]


def synthetic(n, seed=0):
    rng = random.Random(seed)
    plain = ["the soup was cold", "we waited an hour", "lovely terrace and view", "to die for, really", "the {} was fine"]
    bad = {1: "go {} you useless clown", 2: "throw all {} people out of the country", 3: "naked {} on top of me"}
    docs, labels = [], []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 0, 1, 2, 3])
        parts = [rng.choice(plain).format(rng.choice("abcdefg")) for _ in range(rng.randrange(3, 9))]
        if grade:
            parts.insert(rng.randrange(len(parts)), bad[grade].format(rng.choice(["away", "red", "old"])))
        docs.append((i, ". ".join(parts), "s", "x"))
        labels.append((i, [None, *abuse.GRADES][grade + 1].upper() + " ", "r"))
    return docs, labels


def test_trained_scores_separate_and_edge_rows_pass(spark):
    docs, labels = synthetic(400)
    extra = [(1000, None, None, "x"), (1001, "", "s", "x"), (1002, "word " * 100_000, "s", "x"), (None, docs[0][1], "s", "x"), docs[0]]
    df = table(spark, docs + extra, D)
    model = abuse.train(df, table(spark, labels + [(1, None, "r"), (2, "odd", "r"), (99999, "abusive", "r"), (None, "none", "r")], L))
    got = abuse.abuse_scores(df, model, "doc_id", "source", "note").collect()
    truth = {i: "NONE" not in label for i, label, _ in labels}
    flagged = {r.doc_id: r.flagged for r in got}
    assert sum(flagged[i] == t for i, t in truth.items()) >= 395
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + 5 and by_id[1000].severity == by_id[1001].severity == 0
    assert len({r.severity for r in got if r.doc_id == 0}) == 1
    found = rows(abuse.rates(table(spark, [(r.source, r.severity, r.flagged) for r in got], "source string, severity double, flagged boolean")), "source", "documents")
    assert found == [("s", 404), (None, 1)]
    with pytest.raises(ValueError):
        abuse.abuse_scores(df, model, "severity")


def test_without_labels_nothing_is_flagged(spark):
    docs, _ = synthetic(10)
    df = table(spark, docs, D)
    model = abuse.train(df, table(spark, [], L))
    assert not any(r.flagged for r in abuse.abuse_scores(df, model, "doc_id").collect())
    assert rows(abuse.abuse_scores(df.limit(0), model, "doc_id")) == []


def test_sample_is_bounded(spark):
    docs, labels = synthetic(50)
    texts, grades = abuse.labelled_sample(table(spark, docs, D), table(spark, labels, L), 20)
    assert len(texts) == len(grades) == 20


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_accuracy():
    """On documents the model hasn't seen and two raters judge alike; a single rater is wrong now and then."""
    text = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").text
    judged = defaultdict(list)
    for r in pd.read_parquet(f"{DATA}/doc_label.parquet").itertuples():
        label = r.label.strip().lower() if isinstance(r.label, str) else ""
        if label in abuse.GRADES and isinstance(text[r.doc_id], str):
            judged[r.doc_id].append(abuse.GRADES[label])
    held = {i: g[0] for i, g in judged.items() if len(g) > 1 and len(set(g)) == 1}
    seen = [i for i in judged if i not in held][:5000]
    model = abuse.PassageModel().fit(abuse.document_features(text[seen].tolist()), np.array([max(judged[i]) for i in seen]))
    flagged = model.chances(abuse.document_features(text[list(held)].tolist())) >= model.limit
    bad = np.array(list(held.values())) > 0
    assert bad.sum() > 300 and (bad & flagged).sum() >= 0.9 * bad.sum() and (bad & flagged).sum() >= 0.9 * flagged.sum()
