"""Rating predictions from the most similar neighbours.

Test pairs have `user`, `item`, `times` (how often the pair is asked for); predictions come once per asking. Neighbour
weights that aren't stored are 0 and rank above negative ones. Predictions aren't clamped to the scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillstone.plans.cut import cut
from rillstone.plans.spread import ROWS, hot_groups, spread_join

FIRST = 64
AT_ONCE = 2_000_000


def _repeated(df: DataFrame) -> DataFrame:
    return df.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_", "times")


def _places(ranked_by: W, n: int, zero_places: Column) -> Column:
    """How many of the n places a neighbour with `reviews` reviews takes.

    Places go to positive weights, then to the `zero_places` reviews of weight 0 that have no rows here, then to negative
    weights; a neighbour who reviewed more than once takes a place for each review.
    """
    before = F.coalesce(F.sum("reviews").over(ranked_by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = before + F.when(F.col("w") < 0, zero_places).otherwise(F.lit(0))
    return F.least(F.col("reviews"), F.greatest(F.lit(n) - before, F.lit(0)))


def _directed(weights: DataFrame, a: str, b: str, asked: DataFrame) -> DataFrame:
    """(mine, other, w) in both directions, one row each, where `mine` is among the one column of `asked`.

    Where both directions are stored they agree.
    """
    two = F.array(F.struct(F.col(a).alias("mine"), F.col(b).alias("other")), F.struct(F.col(b).alias("mine"), F.col(a).alias("other")))
    both = weights.select(F.explode(two).alias("p"), F.col("sim").alias("w")).select("p.mine", "p.other", "w")
    needed = both.join(asked.toDF("mine").distinct(), "mine", "left_semi")
    return needed.groupBy("mine", "other").agg(F.max("w").alias("w"))


def predict_item_based(ratings: DataFrame, weights: DataFrame, test: DataFrame, n: int = 2, both: bool = False) -> DataFrame:
    """(user, item, stars): mean of the user's ratings of the n items most similar to the item, by weight.

    Pairs whose user is unseen, or whose neighbours all have weight 0, get no row. What the user reviewed besides the items
    with a stored weight counts as places of weight 0 and needs no rows. `both` says that every weight is stored in both
    directions, so that each row is needed once.

    A task holds the weights of some items asked for, the pairs that ask for them and what their users reviewed. It compares
    lists, and only the neighbours that may take a place leave it: a hot user's reviews go to a task once, not to each pair.
    """
    rated = ratings.where("stars IS NOT NULL")
    reviewed = rated.groupBy("user", F.col("item").alias("other")).agg(F.count(F.lit(1)).alias("reviews"), F.avg("stars").alias("r"))
    totals = rated.groupBy("user").agg(F.count(F.lit(1)).alias("all_reviews"))
    near = _near(test, reviewed, weights, n, both).join(totals, "user")
    zeros = F.col("all_reviews") - F.col("known")
    order = W.partitionBy("user", "item").orderBy(F.col("w").desc(), "other")
    taken = near.withColumn("taken", _places(order, n, zeros)).where("taken > 0")
    found = taken.groupBy("user", "item", "times").agg(
        F.sum(F.col("r") * F.col("w") * F.col("taken")).alias("top"), F.sum(F.abs("w") * F.col("taken")).alias("under")
    )
    return _repeated(found.select("user", "item", "times", F.round(F.col("top") / F.col("under"), 6).alias("stars")))


def _near(test: DataFrame, reviewed: DataFrame, weights: DataFrame, n: int, both: bool) -> DataFrame:
    """(user, item, times, other, w, reviews, r, known) of the first neighbours by weight of each test pair, as many as hold n
    reviews; `known` are the reviews of all its neighbours with a weight."""
    tasks = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(tasks)).cast("int").alias("task")
    part = lambda df, kind, a, b, x, k, task: df.select(task, F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), x.cast("double").alias("x"), k.cast("long").alias("k"))
    none = F.lit(None)
    stored = weights.where("sim <> 0 AND b1 IS NOT NULL AND b2 IS NOT NULL")
    one = part(stored, 0, "b1", "b2", F.col("sim"), none, at("b1"))
    every = one if both else one.unionByName(part(stored, 0, "b2", "b1", F.col("sim"), none, at("b2")))
    asked = test.select("user", at("item")).distinct()
    theirs = part(reviewed.join(asked, "user"), 1, "user", "other", F.col("r"), F.col("reviews"), F.col("task"))
    rows = every.unionByName(theirs).unionByName(part(test, 2, "user", "item", none, F.col("times"), at("item")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield from _first_neighbours(pa.Table.from_batches(held), n)

    schema = "user string, item string, times long, other string, w double, reviews long, r double, known long"
    return rows.repartitionById(tasks, F.col("task")).drop("task").mapInArrow(first, schema)


def _first_neighbours(t: pa.Table, n: int, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of `_near` from the weights, reviews and pairs of a task: kinds 0, 1 and 2."""
    kinds = [t.filter(pc.equal(t.column("kind"), k)) for k in range(3)]
    if not all(len(x) for x in kinds):
        return
    del t
    (item, other, w), (reviewer, seen, r), (user, wanted, _) = ([_whole(x.column(c)) for c in ("a", "b", "x")] for x in kinds)
    reviews, times = (x.column("k").to_numpy() for x in kinds[1:])
    items, users = wanted.unique(), user.unique()
    stored, of_item = _places_in(items, item)
    others = other.filter(pa.array(stored)).unique()
    others = others.take(pc.sort_indices(others))
    width = len(others)
    keys = of_item * width + _places_in(others, other.filter(pa.array(stored)))[1]
    w = w.to_numpy()[stored]
    order = np.lexsort((w, keys))
    keys, w = keys[order], w[order]
    last = np.r_[keys[1:] != keys[:-1], True] if len(keys) else np.zeros(0, bool)  # the larger one where a weight is stored twice
    keys, w = keys[last], w[last]
    met, what = _places_in(others, seen)
    known, who = _places_in(users, reviewer.filter(pa.array(met)))
    what, r, reviews = what[known], r.to_numpy()[met][known], reviews[met][known]
    order = np.argsort(who, kind="stable")
    what, r, reviews = what[order], r[order], reviews[order]
    length = np.bincount(who, minlength=len(users))
    start = np.cumsum(length) - length
    asker, of = _places_in(users, user)[1], _places_in(items, wanted)[1]
    done = np.cumsum(length[asker])
    at = 0
    while at < len(asker) and len(keys):
        to = max(int(np.searchsorted(done, (done[at - 1] if at else 0) + at_once, "right")), at + 1)
        size = length[asker[at:to]]
        entry = np.repeat(start[asker[at:to]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        pair = np.repeat(np.arange(at, to), size)
        key = of[pair] * width + what[entry]
        p = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[p] == key
        pair, entry, p = pair[hit], entry[hit], p[hit]
        order = np.lexsort((what[entry], -w[p], pair))
        pair, entry, p = pair[order], entry[order], p[order]
        each = np.bincount(pair - at, reviews[entry], to - at).astype(np.int64)
        upto = np.cumsum(reviews[entry]) - reviews[entry]
        begins = np.searchsorted(pair, pair)
        keep = upto - upto[begins] < n
        pair, entry, p = pair[keep], entry[keep], p[keep]
        found = [user.take(pa.array(pair)), wanted.take(pa.array(pair)), times[pair], others.take(pa.array(what[entry])), w[p], reviews[entry], r[entry], each[pair - at]]
        yield pa.record_batch([pa.array(x) for x in found], names=["user", "item", "times", "other", "w", "reviews", "r", "known"])
        at = to


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _places_in(values: pa.Array, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of a column are among the distinct `values`, and the places of these."""
    found = pc.index_in(column, values)
    there = found.is_valid().to_numpy(zero_copy_only=False)
    return there, found.drop_null().to_numpy().astype(np.int64)


def predict_user_average(ratings: DataFrame, averages: DataFrame, test: DataFrame) -> DataFrame:
    """(user, item, stars): the user's average; null if the item is unseen or the user has no average.

    This is what the user-based form gives when no weight is ever found.
    """
    seen = ratings.select("item").distinct().withColumn("seen", F.lit(True))
    known = test.join(seen, "item", "left").join(averages, "user", "left")
    return _repeated(known.select("user", "item", "times", F.when(F.col("seen"), F.col("avg_stars")).alias("stars")))


def _raters(ratings: DataFrame, averages: DataFrame) -> DataFrame:
    """(item, other, reviews, r, avg_other): every rater of an item, with the mean rating and the average, null where missing."""
    counts = ratings.groupBy("item", F.col("user").alias("other")).agg(F.count(F.lit(1)).alias("reviews"), F.avg("stars").alias("r"))
    theirs = averages.select(F.col("user").alias("other"), F.col("avg_stars").alias("avg_other"))
    return counts.join(theirs, "other", "left")


def _user_parts(near: DataFrame, n: int) -> DataFrame:
    """Sums over the places of each pair from rows (user, item, other, w, reviews, r, avg_other)."""
    order = W.partitionBy("user", "item").orderBy(F.col("w").desc(), "other")
    taken = near.withColumn("taken", _places(order, n, F.lit(0))).where("taken > 0")
    return taken.groupBy("user", "item").agg(
        F.sum((F.col("r") - F.col("avg_other")) * F.col("w") * F.col("taken")).alias("top"),
        F.sum(F.abs("w") * F.col("taken")).alias("under"),
        F.count_if(F.col("r").isNull() | F.col("avg_other").isNull()).alias("missing"),
    )


def predict_user_based(ratings: DataFrame, weights: DataFrame, averages: DataFrame, test: DataFrame, n: int = 2, first: int = FIRST) -> DataFrame:
    """(user, item, stars): the user's average plus the weighted deviations of the n most similar raters of the item.

    In this order: null if the item is unseen or the user has no average; the average if all chosen weights are 0; null
    if a chosen rater has no average or no rating; else the weighted mean.

    A pair meets the raters the user has a stored weight with, and the `first` raters of the item by id, who fill places
    of weight 0. Where the item has more raters, but fewer than n of those first ones have weight 0 for the user, the pair
    meets all raters instead; such pairs are few, as the user needs stored weights with nearly all of the first ones. Only
    the raters of the items asked for and the weights of the users asked for are read, and a hot item's raters are joined in
    parts.
    """
    asked = cut(test.join(averages, "user", "left"), "asked")
    able = asked.where("avg_stars IS NOT NULL").select("user", "item")
    raters = cut(_raters(ratings.join(able.select("item").distinct(), "item", "left_semi"), averages), "raters")
    by_id = W.partitionBy("item").orderBy("other")
    leading = raters.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= first)
    sizes = cut(raters.groupBy("item").agg(F.count(F.lit(1)).alias("raters")), "sizes")
    many = sizes.where(F.col("raters") > first).select("item")
    stored = cut(_directed(weights, "u1", "u2", able.select("user")).withColumnRenamed("mine", "user"), "weights")
    known = able.join(stored, "user").join(raters, ["item", "other"])
    filling = able.join(leading.drop("at"), "item").join(stored, ["user", "other"], "left")
    unstored = filling.where("w IS NULL").withColumn("w", F.lit(0.0))
    near = known.unionByName(unstored.select(known.columns))
    short = (
        able.join(many, "item")
        .join(filling.where("coalesce(w, 0) = 0").groupBy("user", "item").agg(F.count(F.lit(1)).alias("zeros")), ["user", "item"], "left")
        .where(F.coalesce("zeros", F.lit(0)) < n)
        .select("user", "item")
    )
    hot = hot_groups(sizes, ["item"], "raters", ROWS, raters.count())
    met = spread_join(raters, short, ["item"], hot, "other")
    rest = met.join(stored, ["user", "other"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    parts = _user_parts(near.join(short, ["user", "item"], "left_anti"), n).unionByName(_user_parts(rest, n))
    full = asked.join(parts, ["user", "item"], "left")
    stars = (
        F.when(F.col("under").isNull() | F.col("avg_stars").isNull(), F.lit(None))
        .when(F.col("under") == 0, F.col("avg_stars"))
        .when(F.col("missing") > 0, F.lit(None))
        .otherwise(F.col("avg_stars") + F.try_divide("top", "under"))
    )
    return _repeated(full.select("user", "item", "times", F.round(stars.cast("double"), 6).alias("stars")))
