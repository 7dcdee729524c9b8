"""Items that appear together: exact pair counts against a bipartite configuration null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillstone.operators.setsim import meeting
from rillstone.plans.cut import cut
from rillstone.plans.spread import ROWS, hot_groups, spread_join

HEAVY_BASKET = 64
MOST_HEAVY = 256
EXACT_SIZES = 512
SIZE_STEP = 1.02


def edges_of(inc: DataFrame) -> DataFrame:
    """The distinct (key, member) rows of an incidence, without nulls, as a table."""
    return cut(inc.select("key", "member").where("key IS NOT NULL AND member IS NOT NULL").distinct(), "edges")


def _counted(rows: DataFrame) -> DataFrame:
    """(k1, k2, c) of the ids that share members, from a table (id, member) of distinct rows."""
    met = meeting(rows).groupBy(F.col("id1").alias("k1"), F.col("id2").alias("k2"))
    return met.agg(F.count(F.lit(1)).alias("c"))


def pair_counts(inc: DataFrame, least: int = 5, most_share: float | None = None, distinct: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(k1, k2, c, n1, n2) of every pair of items with c >= `least` common baskets, the (key, n) of all items, and the
    number of baskets.

    `inc` has `key` (item) and `member` (basket); nulls drop out, repeats count once. With `distinct`, `inc` is what
    `edges_of` gives and is used as it is. Items in fewer than `least` baskets
    can't be in a pair, nor, if `most_share` is given, those in more than that share of all baskets.

    The up to `MOST_HEAVY` largest baskets (above `HEAVY_BASKET` items) emit no pairs: each item carries a bit for each of
    them, and two items' common ones are counted from the bits. A pair with `least` common baskets that shares only
    heavy ones still shares one that is not among the `least - 1` largest of either item, and is found through that. With
    `least` 1 every pair of a basket comes out in any case, so all baskets emit their pairs.
    """
    edges = inc if distinct else edges_of(inc)
    spark = edges.sparkSession
    items = cut(edges.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "items")
    baskets = edges.groupBy("member").agg(F.count(F.lit(1)).alias("m"))
    n_baskets = edges.select("member").distinct().count()
    able = items.where(F.col("n") >= least)
    if most_share is not None:
        able = able.where(F.col("n") <= F.lit(most_share * n_baskets))
    able = cut(able.withColumn("id", F.monotonically_increasing_id()), "able")
    heavy = [r.member for r in baskets.where(F.col("m") > HEAVY_BASKET).orderBy(F.col("m").desc(), "member").limit(MOST_HEAVY).collect()] if least > 1 else []
    numbered = spread_join(edges, able, ["key"], hot_groups(able, ["key"], "n", ROWS, edges.count()), "member").select("id", "member")
    words = MOST_HEAVY // 64
    if heavy:
        table = F.broadcast(spark.createDataFrame(list(zip(heavy, range(len(heavy)))), f"member {edges.schema['member'].dataType.simpleString()}, bit int"))
        light = numbered.join(table, "member", "left_anti")
        own = cut(numbered.join(table, "member").select("id", "bit"), "heavy")
        bit = lambda w: F.expr(f"IF(bit DIV 64 = {w}, shiftleft(1L, bit % 64), 0L)")
        bits = own.groupBy("id").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in range(words)])
        # Bits are in order of size, so the `least - 1` largest baskets of an item are its smallest bits.
        order = W.partitionBy("id").orderBy("bit")
        later = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") >= least)
        only_heavy = _counted(cut(later.select("id", F.col("bit").alias("member")), "later")).withColumn("c", F.lit(0).cast("long"))
    else:
        light = numbered
        bits = spark.createDataFrame([], "id long, " + ", ".join(f"w{w} long" for w in range(words)))
        only_heavy = None
    pairs = _counted(cut(light, "light"))
    if only_heavy is not None:
        pairs = pairs.unionByName(only_heavy).groupBy("k1", "k2").agg(F.sum("c").alias("c"))
    about = cut(able.join(bits, "id", "left"), "about")
    side = lambda i: about.select(F.col("id").alias(f"k{i}"), F.col("key").alias(f"key{i}"), F.col("n").alias(f"n{i}"), *[F.col(f"w{w}").alias(f"w{w}_{i}") for w in range(words)])
    shared = sum((F.bit_count(F.coalesce(F.col(f"w{w}_1").bitwiseAND(F.col(f"w{w}_2")), F.lit(0))) for w in range(words)), F.lit(0))
    full = pairs.join(side(1), "k1").join(side(2), "k2").withColumn("c", F.col("c") + shared).where(F.col("c") >= least)
    swap = F.col("key1") < F.col("key2")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    named = full.select(pick("key1", "key2").alias("k1"), pick("key2", "key1").alias("k2"), "c", pick("n1", "n2").alias("n1"), pick("n2", "n1").alias("n2"))
    return named, items, n_baskets


def degree_classes(df: DataFrame, column: str) -> list[tuple[float, int]]:
    """(mean size, number) of the classes of sizes in `column`, in rising order.

    Sizes up to `EXACT_SIZES` have a class of their own; larger ones share classes `SIZE_STEP` wide, so a few thousand
    classes reach the driver at any scale.
    """
    d = F.col(column).cast("double")
    kind = F.when(d <= EXACT_SIZES, d).otherwise(EXACT_SIZES + 1 + F.floor(F.log(d / EXACT_SIZES) / F.log(F.lit(SIZE_STEP))))
    found = df.groupBy(kind.alias("kind")).agg(F.avg(d).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((float(r["size"]), int(r["n"])) for r in found)


class ConfigurationNull:
    """Independent memberships p(item, basket) = x y / (1 + x y), with x by basket size and y by item frequency.

    The x and y are fitted so that every size and every frequency is met in expectation. Both are given as classes (size, number).
    """

    def __init__(self, items: list[tuple[float, int]], baskets: list[tuple[float, int]], rounds: int = 2000, tolerance: float = 1e-9):
        (self.d, nd), (self.k, self.nk) = (np.array(sorted(c), float).reshape(-1, 2).T for c in (items, baskets))
        links = max(float((self.d * nd).sum()), 1.0)
        x, y = self.k / np.sqrt(links), self.d / np.sqrt(links)
        for _ in range(rounds):
            q = 1 / (1 + np.outer(x, y))
            x_new = self.k / np.maximum((q * (nd * y)).sum(1), 1e-300)
            q = 1 / (1 + np.outer(x_new, y))
            y_new = self.d / np.maximum((q * (self.nk * x_new)[:, None]).sum(0), 1e-300)
            moved = np.abs(np.log(y_new / y)).max(initial=0)
            x, y = x_new, y_new
            if moved < tolerance:
                break
        xy = np.outer(x, y)
        self.p = xy / (1 + xy)

    def log10_tail(self, d1: np.ndarray, d2: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected common baskets, and log10 P(C >= c) of the Poisson-binomial count C by the saddlepoint method."""
        at = [np.abs(np.log(self.d[None, :] / d[:, None])).argmin(1) for d in (d1.astype(float), d2.astype(float))]
        p = self.p[:, at[0]] * self.p[:, at[1]]
        n = self.nk[:, None]
        mean = (n * p).sum(0)
        c = c.astype(float)
        s = np.log(np.maximum(c, 1e-9) / np.maximum(mean, 1e-300))
        for _ in range(60):
            e = p * np.exp(np.clip(s, -50, 700))
            t = e / (1 - p + e)
            step = ((n * t).sum(0) - c) / np.maximum((n * t * (1 - t)).sum(0), 1e-300)
            s -= np.clip(step, -1, 1)
            if np.abs(step).max(initial=0) < 1e-10:
                break
        e = p * np.exp(np.clip(s, -50, 700))
        t = e / (1 - p + e)
        cumulant = (n * np.log1p(p * np.expm1(np.clip(s, -50, 700)))).sum(0)
        v2 = (n * t * (1 - t)).sum(0)
        # Lattice form of the saddlepoint tail; its leading factor alone where the root and the deviance agree too closely.
        w2 = np.maximum(2 * (s * c - cumulant), 0)
        w, u = np.sqrt(w2), (1 - np.exp(-np.abs(s))) * np.sqrt(v2)
        upper = c > mean + 0.5
        log_phi = -w2 / 2 - 0.5 * np.log(2 * np.pi)
        mills = np.where(w > 1e-6, self._mills(w), 1.25)
        term = mills + np.where((u > 1e-9) & (w > 1e-9), 1 / np.maximum(u, 1e-12) - 1 / np.maximum(w, 1e-12), 0)
        log10 = (log_phi + np.log(np.maximum(term, 1e-300))) / np.log(10)
        return mean, np.where(upper, np.minimum(log10, 0.0), 0.0)

    @staticmethod
    def _mills(w: np.ndarray) -> np.ndarray:
        """(1 - Phi(w)) / phi(w) by continued fraction, by series for small w."""
        f = np.zeros_like(w)
        for k in range(60, 0, -1):
            f = k / (w + f)
        large = 1 / (w + f)
        term, total = w.copy(), w.copy()
        for k in range(1, 60):
            term = term * w * w / (2 * k + 1)
            total = total + term
        small = np.sqrt(np.pi / 2) * np.exp(np.minimum(w * w / 2, 50)) - total
        return np.where(w > 2.5, large, small)


def surprise(pairs: DataFrame, items: DataFrame, baskets: DataFrame, n_baskets: int, least: int = 5, q_most: float = 0.05) -> DataFrame:
    """(k1, k2, c, n1, n2, lift, expected, log10_p, q, surprising) for counted pairs.

    The tail probability is that of the null; q adjusts it for false discovery over all pairs of items with at least
    `least` baskets, pairs that don't occur counting as p = 1. P-values are rounded up to a thousandth of a decade, so that
    the adjustment needs only their counts, not a sort of all pairs in one place.
    """
    null = ConfigurationNull(degree_classes(items, "n"), degree_classes(baskets, "m"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                mean, tail = null.log10_tail(part.low.to_numpy(), part.high.to_numpy(), part.c.to_numpy())
                yield part.assign(expected=mean, thousandths=np.ceil(np.maximum(tail, -1000.0) * 1000).astype(int))

    # The null knows a pair by its frequencies and count only: each kind of pair is scored once.
    counted = cut(pairs.withColumns({"low": F.least("n1", "n2"), "high": F.greatest("n1", "n2")}), "counted")
    kind = ["low", "high", "c"]
    kinds = counted.groupBy(*kind).agg(F.count(F.lit(1)).alias("pairs")).repartition(counted.sparkSession.sparkContext.defaultParallelism)
    scored = cut(kinds.mapInPandas(score, "low long, high long, c long, pairs long, expected double, thousandths long"), "kinds")
    able = items.where(F.col("n") >= least).count()
    tests = max(able * (able - 1) / 2, 1.0)
    counts = sorted((int(r[0]), int(r[1])) for r in scored.groupBy("thousandths").agg(F.sum("pairs")).collect())
    ranks = np.cumsum([n for _, n in counts]) if counts else np.zeros(0)
    q = np.array([10.0 ** (t / 1000) for t, _ in counts]) * tests / np.maximum(ranks, 1)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1.0)
    table = scored.sparkSession.createDataFrame([(t, float(x)) for (t, _), x in zip(counts, q)], "thousandths long, q double")
    lift = F.col("c") * F.lit(float(n_baskets)) / (F.col("n1") * F.col("n2"))
    judged = cut(scored.join(F.broadcast(table), "thousandths"), "judged")
    return counted.join(judged, kind).select(
        "k1", "k2", "c", "n1", "n2", lift.alias("lift"), "expected", (F.col("thousandths") / 1000).alias("log10_p"), "q", (F.col("q") <= q_most).alias("surprising")
    )


def basket_sizes(edges: DataFrame) -> DataFrame:
    """(member, m) of every basket."""
    return edges.where("key IS NOT NULL AND member IS NOT NULL").select("key", "member").distinct().groupBy("member").agg(F.count(F.lit(1)).alias("m"))
