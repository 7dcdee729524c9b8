import random

import numpy as np
import pytest

from rillstone.llm import leakage

from ..conftest import rows, table

D, I = "doc_id long, text string, item_id long, tiles int", "item_id long, text string, suite string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello, World! 42x", ["hello", "world", "42x"]),
        ("<p>One</p><p>two</p> th<b>re</b>e", ["one", "two", "three"]),
        ("caf&eacute; &amp; náive so­ft zero​width ﬁne x² ＡＢ", ["cafe", "naive", "soft", "zerowidth", "fine", "x2", "ab"]),
        ("snake_case a&nbsp;b", ["snake", "case", "a", "b"]),
        ("STRASSE straße", ["strasse", "straße"]),
        ("", []),
        (None, []),
        ("<><<>>", []),
        ("3 < 5 and 6 > 2 <!-- no --> <br/>end", ["3", "5", "and", "6", "2", "end"]),
    ],
)
def test_plain_words(text, want):
    assert leakage.plain_words(text) == want


def longest_common_run(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = last[j] + 1
                best = max(best, row[j + 1])
        last = row
    return best


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 20, 40])))) for i in range(12)]
    items += [(100, items[3][1] + " tail"), (101, None), (102, "")]
    docs = []
    for d in range(60):
        parts = [word() for _ in range(rng.randrange(60))]
        source = items[rng.randrange(12)][1].split()
        at = rng.randrange(len(source))
        parts[rng.randrange(len(parts) + 1) : 0] = source[at : at + rng.choice([3, 11, 12, 13, 30])]
        docs.append((d, " ".join(parts) if d % 9 else " ".join(parts).upper().replace(" ", ", ")))
    return docs + [(900, None), (901, ""), (902, docs[0][1])], items


@pytest.mark.parametrize(("bits", "most_bits", "part"), [(64, leakage.MOST_BITS, 10_000), (1, 1 << 16, 3), (0, 0, 10_000)])
def test_leaks_equal_brute_force(spark, monkeypatch, bits, most_bits, part):
    """With a filter that lets little through, with windows in parts, and with a filter of least size."""
    monkeypatch.setattr(leakage, "BITS_PER_WINDOW", bits)
    monkeypatch.setattr(leakage, "SEEDS_PER_TASK", part)
    docs, items = corpus(5)
    got = leakage.leaks(table(spark, [(*d, 7, 7) for d in docs] + [(None, "x", 1, 1), (*docs[3], 8, 8)], D), table(spark, [(*i, "s") for i in items] + [(None, "x", "s"), (*items[3], "t")], I), 12, most_bits)
    want = {}
    for d, t in docs:
        for i, q in items:
            n = longest_common_run(leakage.plain_words(t), leakage.plain_words(q))
            if n >= 12:
                want[d, i] = n
    found = rows(got, "doc_id", "item_id", "longest")
    assert len(want) >= 10 and len(found) == len(set(found)) and {r[:2]: r[2] for r in found} == want


def test_reordered_passages_are_covered(spark):
    item = [f"q{i}" for i in range(30)]
    text = " ".join(item[20:] + ["x"] + item[10:20] + ["y"] + item[:10])
    (got,) = leakage.leaks(table(spark, [(1, text, 0, 0)], D), table(spark, [(2, " ".join(item), "s")], I), 5).collect()
    assert (got.tiles, got.longest, got.covered, got.coverage) == (3, 10, 30, 1.0)


def test_tiles_do_not_overlap():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(5, 25))] for _ in range(2))
        hits = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        tiles = leakage.tile(hits, 3)
        for side, x in ((0, a), (1, b)):
            marked = [k for t in tiles for k in range(t[side], t[side] + t[2])]
            assert len(marked) == len(set(marked)) and all(k < len(x) for k in marked)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in tiles)
        longest = longest_common_run(a, b)
        assert max((n for _, _, n in tiles), default=0) == (longest if longest >= 3 else 0)


def test_long_text_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(15))
    long = ("filler words " * 150_000) + item
    assert rows(leakage.leaks(table(spark, [(1, long, 0, 0)], D), table(spark, [(2, item, "s")], I)), "doc_id", "longest") == [(1, 15)]
    assert rows(leakage.leaks(table(spark, [], D), table(spark, [(2, item, "s")], I))) == []
    assert rows(leakage.leaks(table(spark, [(1, item, 0, 0)], D), table(spark, [], I))) == []


def test_an_id_with_several_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    docs = table(spark, [(1, one + " x " + one, 0, 0), (1, "y " + two, 0, 0), (2, two, 0, 0), (2, two, 0, 0)], D)
    got = rows(leakage.leaks(docs, table(spark, [(5, one, "s"), (5, two, "s"), (6, "b3 " + two, "s")], I)), "doc_id", "item_id", "longest", "covered")
    assert got == [(1, 5, 20, 20), (1, 6, 20, 20), (2, 5, 20, 20), (2, 6, 20, 20)]


def test_filter_knows_every_window(spark):
    df = table(spark, [(1, 1, " ".join(f"w{i}" for i in range(3000)))], "id long, text_hash long, text string")
    windows = df.mapInArrow(leakage._windows(5), leakage.WINDOWS)
    field = np.frombuffer(leakage._bitmap(windows, 1 << 17), np.uint8)
    h = np.array([r.h for r in windows.collect()], np.int64).view(np.uint64)
    assert len(h) == 2996
    bit = lambda x: np.logical_and.reduce([(field[(s >> np.uint64(3)).astype(int)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 for s in leakage.slots(x, 1 << 17)])
    assert bit(h).all() and bit(np.random.default_rng(0).integers(0, 1 << 63, 10_000).astype(np.uint64)).mean() < 0.01
