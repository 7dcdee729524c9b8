"""Word profiles: counts, document frequency, TF-IDF, profiles of items and users, and scores between them.

Documents have `item` and `text`; several rows with one item are one document. Null items drop out, null and empty texts
have no words, but their item counts as a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillstone.functions.similarity import binary_cosine, containment
from rillstone.functions.text import is_term, pieces
from rillstone.plans.cut import cut
from rillstone.plans.shelf import Shelf, numbers, part_of, shelved

RARE = 0.0001
PROFILE_WORDS = 200
MOST_BROADCAST = 100_000
REVIEWS_PER_TASK = 20_000
REVIEW_WORDS = 1_000_000
ITEMS_PER_PART = 2_000
USERS_AT_ONCE = 500
ROWS_AT_ONCE = 100_000
PROFILE_BLOCK = 1_000
MOST_ENTRIES = 5_000_000
DENSE_WORDS = 4_096
CODE_BITS = 32
WORDS = "words.list.element"


def tokens(docs: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """The rows of `docs` without `text`, once for each term of the text with the term as `word`; terms keep their repeats."""
    named = docs.where("item IS NOT NULL")
    return named.withColumn("word", F.explode(pieces("text"))).drop("text").where(is_term("word", stopwords))


def term_freq(toks: DataFrame) -> DataFrame:
    """(item, word, tf): occurrences; counts are combined before the shuffle."""
    return toks.groupBy("item", "word").agg(F.count(F.lit(1)).alias("tf"))


def doc_word_counts(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """(item, n_words) from term frequencies, with 0 for a document without words."""
    sums = tf.groupBy("item").agg(F.sum("tf").alias("n_words"))
    every = docs.where("item IS NOT NULL").select("item").distinct()
    return every.join(sums, "item", "left").select("item", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """(word, df): number of documents a word occurs in."""
    return tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def frequent_words(dfs: DataFrame, counts: DataFrame, least: float = RARE) -> DataFrame:
    """(word, df) of the words whose documents are at least `least` of all words in the collection.

    Documents per word add up to no more than the words of the collection, so at most 1 / least words are kept; if these are few,
    the result is marked for broadcast.
    """
    total = counts.agg(F.sum("n_words").cast("double").alias("total"))
    kept = dfs.join(F.broadcast(total)).where(F.col("df") >= F.col("total") * F.lit(least)).select("word", "df")
    return F.broadcast(kept) if least * MOST_BROADCAST >= 1 else kept


def tfidf(tf: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(item, word, score) = tf / words of the document * log2(documents / df), rounded to 9 digits.

    The words of a document are counted before rare words are dropped.
    """
    n_docs = counts.agg(F.count(F.lit(1)).alias("n_docs"))
    score = F.col("tf") / F.col("n_words") * F.log2(F.col("n_docs") / F.col("df"))
    return tf.join(kept, "word").join(counts, "item").join(F.broadcast(n_docs)).select("item", "word", F.round(score, 9).alias("score"))


def tfidf_smoothed(tf: DataFrame, counts: DataFrame, dfs: DataFrame) -> DataFrame:
    """(item, word, score) = tf / words of the document * ln(documents / (df + 1))."""
    n_docs = counts.agg(F.count(F.lit(1)).alias("n_docs"))
    score = F.col("tf") / F.col("n_words") * F.ln(F.col("n_docs") / (F.col("df") + 1))
    return tf.join(dfs, "word").join(counts, "item").join(F.broadcast(n_docs)).select("item", "word", F.round(score, 9).alias("score"))


def top_words(scores: DataFrame, n: int = PROFILE_WORDS) -> DataFrame:
    """(item, word, score): the n best words of each item, ties by the smaller word."""
    order = W.partitionBy("item").orderBy(F.col("score").desc(), "word")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def item_arrays(profile: DataFrame) -> DataFrame:
    """(item, words, scores) of rows (item, word, score), one row for each item."""
    each = profile.where("item IS NOT NULL AND word IS NOT NULL").groupBy("item").agg(F.collect_list(F.struct("word", "score")).alias("e"))
    return each.select("item", F.col("e.word").alias("words"), F.col("e.score").cast("array<double>").alias("scores"))


def shelved_profiles(profile: DataFrame) -> Shelf:
    """(item, words, scores) of the items of rows (item, word, score), in parts of about `ITEMS_PER_PART` items."""
    arrays = cut(item_arrays(profile), "profiles")
    return shelved(arrays, "item", max(1, -(-arrays.count() // ITEMS_PER_PART)), "profiles")


def user_words(reviews: DataFrame, profile: DataFrame, mode: str = "intended", n: int = PROFILE_WORDS) -> DataFrame:
    """(user, word) from the profiles (item, word, score) of the items a user reviewed; see `user_arrays`."""
    return user_arrays(reviews, shelved_profiles(profile), mode, n).select(F.col("id").alias("user"), F.explode("words").alias("word"))


def user_arrays(reviews: DataFrame, profile: Shelf, mode: str = "intended", n: int = PROFILE_WORDS) -> DataFrame:
    """(id, words) from the profiles of the items a user reviewed; an item counts once for each review, words are sorted.

    Mode 'intended' ranks words by the sum of their scores. Mode 'compat' ranks the words with their repeats by their second
    character, ties by the smaller word, and keeps the distinct ones among the first n. Only reviews move: a task has all
    reviews of its users and reads the profiles of their items from the shelf, so the words of a review are never written.
    """
    if mode not in ("intended", "compat"):
        raise ValueError("mode must be 'intended' or 'compat'")
    reviewed = cut(reviews.where("user IS NOT NULL AND item IS NOT NULL").groupBy("user", "item").agg(F.count(F.lit(1)).alias("times")), "reviewed")
    tasks = max(1, -(-reviewed.count() // REVIEWS_PER_TASK))
    sent = reviewed.withColumn("part", part_of("item", profile.parts)).repartition(tasks, "user")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield from _words_of_users(pa.Table.from_batches(held), profile, mode, n)

    return sent.mapInArrow(rank, "id string, words array<string>")


def _words_of_users(t: pa.Table, profile: Shelf, mode: str, n: int) -> Iterator[pa.RecordBatch]:
    """The words of the users of one task; it has all their reviews."""
    users = pa.concat_arrays(t.column("user").cast(pa.large_string()).chunks).dictionary_encode()
    owner, users = users.indices.to_numpy().astype(np.int64), users.dictionary
    item, times = pa.concat_arrays(t.column("item").cast(pa.large_string()).chunks), t.column("times").to_numpy()
    order = np.argsort(t.column("part").to_numpy(), kind="stable")
    part = t.column("part").to_numpy()[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    del t
    codes: dict[str, int] = {}
    # Entries of a user and a word, as two numbers in one, and what each adds; they are summed when there are many.
    cells, added, fresh, held = [], [], 0, 0
    for at, stop in zip(starts, np.r_[starts[1:], len(order)]):
        if (block := profile.read(int(part[at]), "item", "words", "scores", words=(WORDS,))) is None:
            continue
        rows = order[at:stop]
        place = pc.index_in(item.take(pa.array(rows)), block.column("item").combine_chunks().cast(pa.large_string()))
        known = place.is_valid().to_numpy(zero_copy_only=False)
        rows, place = rows[known], place.drop_null().to_numpy().astype(np.int64)
        lists = block.column("words").combine_chunks()
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        code, score = _coded(lists, codes), block.column("scores").combine_chunks().flatten().to_numpy()
        start = np.cumsum(length) - length
        done = np.cumsum(length[place])
        i = 0
        while i < len(rows):
            # As many reviews at once as have `REVIEW_WORDS` words, one at least.
            j = max(int(np.searchsorted(done, (done[i - 1] if i else 0) + REVIEW_WORDS, "right")), i + 1)
            width = length[place[i:j]]
            met = np.repeat(start[place[i:j]] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            cells.append(np.repeat(owner[rows[i:j]], width) << CODE_BITS | code[met])
            weight = np.repeat(times[rows[i:j]], width).astype(float)
            added.append(weight * score[met] if mode == "intended" else weight)
            fresh += len(met)
            if fresh > max(4 * REVIEW_WORDS, held):
                cells, added = ([x] for x in _summed(cells, added))
                fresh, held = 0, len(cells[0])
            i = j
    if not held + fresh:
        return
    cell, total = _summed(cells, added)
    owner, code = cell >> CODE_BITS, cell & ((1 << CODE_BITS) - 1)
    words = sorted(codes)
    rank = np.empty(len(words), np.int64)
    rank[[codes[w] for w in words]] = np.arange(len(words))
    code = rank[code]
    if mode == "intended":
        # Scores have nine digits: the nearest of these drops what adding in any order leaves, before six are kept.
        order = np.lexsort((code, -np.floor((np.rint(total * 1e9) + 500) / 1000), owner))
    else:
        second = np.unique([w[1:2] for w in words], return_inverse=True)[1]
        order = np.lexsort((code, -second[code], owner))
    owner, code, total = owner[order], code[order], total[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[first, len(owner)])
    before = np.arange(len(owner)) if mode == "intended" else (np.cumsum(total) - total).astype(np.int64)
    keep = before - np.repeat(before[first], size) < n
    owner, code = owner[keep], code[keep]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)] if len(owner) else np.zeros(1, np.int64)
    vocabulary = pa.array(words, pa.string())
    for i in range(0, len(first) - 1, USERS_AT_ONCE):
        ends = first[i : i + USERS_AT_ONCE + 1]
        found = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), vocabulary.take(pa.array(code[ends[0] : ends[-1]])))
        yield pa.record_batch([users.take(pa.array(owner[ends[:-1]])).cast(pa.string()), found], names=["id", "words"])


def _coded(lists: pa.ListArray, codes: dict[str, int]) -> np.ndarray:
    """The words of all lists as numbers; `codes` has those known so far and gets the others."""
    flat = lists.flatten()
    flat = flat if pa.types.is_dictionary(flat.type) else flat.dictionary_encode()
    number = np.array([codes.setdefault(w, len(codes)) for w in flat.dictionary.to_pylist()], np.int64)
    return number[flat.indices.to_numpy()]


def _summed(cells: list[np.ndarray], added: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in their order, and what was added to each."""
    cell, value = np.concatenate(cells), np.concatenate(added)
    order = np.argsort(cell)
    cell = cell[order]
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
    return cell[at], np.add.reduceat(value[order], at) if len(cell) else value


def as_arrays(words: DataFrame, key: str) -> DataFrame:
    """(id, words): sorted word arrays; a profile has at most `PROFILE_WORDS` words, so an array is small."""
    return words.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set("word")).alias("words"))


def score_pairs(test: DataFrame, users: DataFrame, items: DataFrame, kernel: str = "cosine", least: float = 0.01) -> DataFrame:
    """(user, item, sim) of the test pairs with both profiles and sim >= `least`; repeated pairs give repeated rows."""
    both = test.join(users.select(F.col("id").alias("user"), F.col("words").alias("uw")), "user").join(
        items.select(F.col("id").alias("item"), F.col("words").alias("iw")), "item"
    )
    f = {"cosine": binary_cosine, "containment": containment}[kernel]
    scored = both.withColumn("sim", F.round(f(F.col("uw"), F.col("iw")), 6)).where(F.col("sim") >= F.lit(float(least)))
    return scored.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("user", "item", "sim")


def merged_profiles(users: DataFrame, items: DataFrame) -> DataFrame:
    """(id, words, is_item) of both kinds of profiles; an item's wins over a user's of the same id."""
    both = users.select("id", "words", F.lit(False).alias("is_item")).unionByName(items.select("id", "words", F.lit(True).alias("is_item")))
    return both.groupBy("id").agg(F.max_by("words", "is_item").alias("words"), F.max("is_item").alias("is_item"))


def merged_pairs(users: DataFrame, items: DataFrame, least: float = 0.01, block: int = PROFILE_BLOCK) -> DataFrame:
    """(user, item, sim) of all pairs of a user's and an item's profile with a binary cosine >= `least` > 0.

    `users` and `items` have (id, words) with distinct words; a user who is also an item takes no part. Both are the sets a
    caller asks about, and most pairs of them share words, so the result itself grows with their product. Users go in
    blocks of about `block` against blocks of items; a task reads one block of each from the shelves and counts common
    words there. No pair is lost, and profiles don't move for every block of the other side.
    """
    merged = cut(merged_profiles(users, items).where("id IS NOT NULL AND size(words) > 0"), "merged")
    counts = dict(merged.groupBy("is_item").agg(F.count(F.lit(1))).collect())
    sides = []
    for side in (False, True):
        mine = merged.where(F.col("is_item") == side).select("id", "words")
        sides.append(shelved(mine, "id", max(1, -(-counts.get(side, 0) // block)), "profiles"))
    ours, theirs = sides

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (x for b in batches for x in b.column("task").to_pylist()):
            one, two = ours.read(task // theirs.parts, words=(WORDS,)), theirs.read(task % theirs.parts, words=(WORDS,))
            if one is not None and two is not None:
                yield from _block_cosines(one, two, float(least))

    return numbers(merged.sparkSession, ours.parts * theirs.parts).mapInArrow(score, "user string, item string, sim double")


def _block_cosines(users: pa.Table, items: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """(user, item, sim) of the pairs of two blocks that reach `least`, rounded to 6 digits."""
    ids = [t.column("id").combine_chunks().cast(pa.string()) for t in (users, items)]
    lists = [t.column("words").combine_chunks() for t in (users, items)]
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    roots = [np.sqrt(x.astype(float)) for x in sizes]
    codes: dict[str, int] = {}
    mine, theirs = (_coded(x, codes) for x in lists)
    owner, holder = (np.repeat(np.arange(len(x)), x) for x in sizes)
    width = len(ids[1])
    dense = len(codes) <= DENSE_WORDS
    if dense:
        held = np.zeros((width, len(codes)), np.float32)
        held[holder, theirs] = 1
    length = np.bincount(theirs, minlength=len(codes))
    ends = np.cumsum(length)
    holder = holder[np.argsort(theirs, kind="stable")]
    work = np.cumsum(np.bincount(owner, length[mine], minlength=len(ids[0])))
    at = 0
    while at < len(ids[0]):
        # As many users at once as have `MOST_ENTRIES` cells in the table of counts, and entries in the word lists.
        to = at + max(1, MOST_ENTRIES // max(width, len(codes) if dense else 1))
        if not dense:
            to = min(to, max(int(np.searchsorted(work, (work[at - 1] if at else 0) + MOST_ENTRIES, "right")), at + 1))
        to = min(to, len(ids[0]))
        own = slice(*np.searchsorted(owner, (at, to)))
        if dense:
            has = np.zeros((to - at, len(codes)), np.float32)
            has[owner[own] - at, mine[own]] = 1
            c = (has @ held.T).ravel()
        else:
            n = length[mine[own]]
            start = np.repeat(ends[mine[own]] - n - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            c = np.bincount(np.repeat(owner[own] - at, n) * width + holder[start], minlength=(to - at) * width)
        hit = np.flatnonzero(c)
        u, i = hit // width + at, hit % width
        sim = np.floor(c[hit] / (roots[0][u] * roots[1][i]) * 1e6 + 0.5) / 1e6
        keep = np.flatnonzero(sim >= least)
        for j in range(0, len(keep), ROWS_AT_ONCE):
            k = keep[j : j + ROWS_AT_ONCE]
            yield pa.record_batch([ids[0].take(pa.array(u[k])), ids[1].take(pa.array(i[k])), pa.array(sim[k])], names=["user", "item", "sim"])
        at = to


def map_argmax(df: DataFrame, column: str) -> DataFrame:
    """(k1, k2, value) of the largest value in a map of maps, ties by the smaller keys; no row for an empty map."""
    inner = df.select(F.explode(column).alias("k1", "inner")).select("k1", F.explode("inner").alias("k2", "value"))
    best = inner.where("value IS NOT NULL").agg(F.min_by(F.struct("k1", "k2", "value"), F.struct(-F.col("value"), F.col("k1"), F.col("k2"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")
