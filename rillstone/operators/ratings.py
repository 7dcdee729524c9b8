"""Rating cells and Pearson similarity of items or users.

Ratings have the columns `user`, `item`, `stars`. Null stars take no part in means; a cell with nothing but nulls is no
cell. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.similarity import jaccard, pearson_of_sums
from rillstone.operators import blocks
from rillstone.plans.cut import cut


def rating_means(ratings: DataFrame) -> DataFrame:
    """(user, item, r): the mean of all ratings a user gave an item."""
    return ratings.where("stars IS NOT NULL").groupBy("user", "item").agg(F.avg("stars").alias("r"))


def pearson_pairs(ratings: DataFrame, of: str, least_common: int = 3, least_jaccard: float = 0.0) -> DataFrame:
    """(k1, k2, c, jac, sim), k1 < k2: Pearson over the shared members of two entities (`of` = 'item' or 'user').

    Entities need `least_common` members, pairs as many common ones. Means are taken over the shared members only. Pairs
    are counted and summed in blocks, and only those with `least_common` and `least_jaccard` leave a task.
    """
    key, member = (of, {"item": "user", "user": "item"}[of])
    cells = cut(rating_means(ratings).where("user IS NOT NULL AND item IS NOT NULL").select(F.col(key).alias("key"), F.col(member).alias("member"), "r"), "cells")
    found = blocks.counted(*blocks.packed(cells, least_common), least_common, least_jaccard)
    sim = pearson_of_sums(*[F.col(c) for c in ("c", *blocks.SUMS)])
    return found.select("k1", "k2", "c", jaccard(F.col("c"), F.col("n1"), F.col("n2")).alias("jac"), (F.round(sim, 6) + F.lit(0.0)).alias("sim"))


def item_weights(ratings: DataFrame) -> DataFrame:
    """(b1, b2, sim) in both directions, positive similarities only (above 0 after rounding to 6 digits)."""
    one = pearson_pairs(ratings, "item").where("sim > 0")
    return one.select(F.explode(F.array(F.struct(F.col("k1").alias("b1"), F.col("k2").alias("b2")), F.struct(F.col("k2").alias("b1"), F.col("k1").alias("b2")))).alias("p"), "sim").select("p.*", "sim")


def user_weights(ratings: DataFrame, least_jaccard: float = 0.01) -> DataFrame:
    """(u1, u2, sim), u1 < u2; similarities of 0 or less stay."""
    return pearson_pairs(ratings, "user", least_jaccard=least_jaccard).select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), "sim")
