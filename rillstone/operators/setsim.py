"""Pairs of entities with similar sets: exact counts, and MinHash candidates with exact verification.

An incidence has the columns `key` (the entity) and `member`. Null keys and members drop out, repeated rows count once,
other columns are ignored. An empty incidence gives an empty result. Inside, entities are dense numbers in the order of
their keys; keys come back with the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import minhash
from rillstone.functions.similarity import jaccard
from rillstone.operators import blocks
from rillstone.plans.cut import cut
from rillstone.plans.numbering import numbered
from rillstone.plans.spread import ROWS, hot_groups, repeat, split, spread_join

BLOCK = 512
PAIRS_PER_TASK = 2_000_000
MOST_TASKS = 100_000


def incidence(df: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct (key, member) rows without nulls."""
    return df.select(F.col(key).alias("key"), F.col(member).alias("member")).where("key IS NOT NULL AND member IS NOT NULL").distinct()


def set_sizes(inc: DataFrame) -> DataFrame:
    return inc.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def supported(inc: DataFrame, least: int = 3) -> DataFrame:
    """Rows of the keys that have at least `least` members."""
    inc = cut(inc, "incidence")
    sizes = set_sizes(inc)
    large = sizes.where(F.col("n") >= least).select("key")
    return spread_join(inc, large, ["key"], hot_groups(sizes, ["key"], "n", ROWS, inc.count()), "member")


def coded(rows: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """`rows` (key, member, ...) with `id` and `n` in place of the key, and (id, key, n) of the entities with `least` members.

    `rows` is a table that can be read again, as are both results.
    """
    keys = numbered(set_sizes(rows).where(F.col("n") >= least), "key", "id")
    found = spread_join(rows, keys, ["key"], hot_groups(keys, ["key"], "n", ROWS, rows.count()), "member").drop("key")
    return cut(found, "coded"), keys


def named(pairs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """(k1, k2, columns) of pairs (id1, id2, columns)."""
    one, two = (keys.select(F.col("id").alias(f"id{i}"), F.col("key").alias(f"k{i}")) for i in (1, 2))
    return pairs.join(one, "id1").join(two, "id2").select("k1", "k2", *columns)


def meeting(rows: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """(id1, id2, columns with 1 and 2) for every member two entities id1 < id2 share: one row for each.

    An equi-join on the member. The rows of a member with more than `block` entities are split by a hash of the entity on
    one side and repeated for the parts on the other, before any join on the member. The number of tasks follows the number
    of pairs, which the sizes of the groups tell, and not the size of the few rows they come from. `rows` is a table.
    """
    sizes = rows.groupBy("member").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    total, work = sizes.agg(F.sum("m"), F.sum(F.col("m").cast("double") * F.col("m") / 2)).first()
    hot = hot_groups(sizes, ["member"], "m", block, total or 0)
    tasks = int(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min((work or 0) / PAIRS_PER_TASK, MOST_TASKS)))
    side = lambda i: rows.select("member", *[F.col(c).alias(f"{c}{i}") for c in ("id", *columns)])
    by = ["member", "__part"]
    left = split(side(1), ["member"], hot, "id1").repartition(tasks, *by)
    right = repeat(side(2), ["member"], hot).repartition(tasks, *by)
    return left.join(right, by).where("id1 < id2").drop(*by)


def common_members(inc: DataFrame, least: int = 1, block: int = BLOCK) -> DataFrame:
    """(k1, k2, c) for every pair k1 < k2 with at least `least` common members.

    Where one common member is enough, pairs meet by member, those with more than `block` entities in parts. Else most
    pairs drop out once they are counted, so they are counted in blocks.
    """
    rows = cut(inc.select("key", "member").where("key IS NOT NULL AND member IS NOT NULL").distinct(), "incidence")
    if least > 1:
        return blocks.counted(*blocks.packed(rows, least), least).select("k1", "k2", "c")
    rows, keys = coded(rows)
    return named(meeting(rows, block=block).groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("c")), keys, "c")


def count_pairs(pairs: DataFrame, rows: DataFrame, *sums: Column) -> DataFrame:
    """(id1, id2, n1, n2, c, sums) of pairs (id1, id2, n1, n2), counted from the members of the smaller entity of each.

    `sums` are aggregates over `x` and `y`, the column `r` of the first and of the second entity at a common member.
    """
    extra = ["r"] if sums else []
    first = F.col("n1") <= F.col("n2")
    sided = pairs.withColumns({"small": F.when(first, F.col("id1")).otherwise(F.col("id2")), "large": F.when(first, F.col("id2")).otherwise(F.col("id1"))})
    one = rows.select(F.col("id").alias("small"), "member", *[F.col(c).alias("rs") for c in extra])
    two = rows.select(F.col("id").alias("large"), "member", *[F.col(c).alias("rl") for c in extra])
    both = sided.join(one, "small").join(two, ["large", "member"])
    if sums:
        same = F.col("small") == F.col("id1")
        both = both.withColumns({"x": F.when(same, F.col("rs")).otherwise(F.col("rl")), "y": F.when(same, F.col("rl")).otherwise(F.col("rs"))})
    return both.groupBy("id1", "id2", "n1", "n2").agg(F.count(F.lit(1)).alias("c"), *sums)


def exact_pairs(inc: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(k1, k2, sim) of all pairs with Jaccard >= `threshold` > 0, counted in blocks: only these pairs leave a task."""
    rows = cut(inc.select("key", "member").where("key IS NOT NULL AND member IS NOT NULL").distinct(), "incidence")
    return _reaching(blocks.counted(*blocks.packed(rows), near=float(threshold)), threshold).select("k1", "k2", "sim")


def _reaching(counts: DataFrame, threshold: float) -> DataFrame:
    return counts.withColumn("sim", jaccard(F.col("c"), F.col("n1"), F.col("n2"))).where(F.col("sim") >= F.lit(float(threshold)))


def signatures(inc: DataFrame, family: minhash.HashFamily = minhash.HashFamily(), hashes: int = 50, first: int = 1) -> DataFrame:
    """(key, sig): minima over the numbered members, one aggregate per hash function, combined before the shuffle.

    Members are numbered from 0 in their order, so that signatures don't depend on the run.
    """
    inc = cut(inc.select("key", "member"), "members")
    numbers = numbered(inc.groupBy("member").agg(F.count(F.lit(1)).alias("m")), "member").select("member", "m", family.member_base(F.col("number")).alias("t"))
    base = spread_join(inc, numbers.drop("m"), ["member"], hot_groups(numbers, ["member"], "m", ROWS, inc.count()), "key")
    mins = [family.least("t", i).alias(f"h{i}") for i in range(first, first + hashes)]
    found = base.groupBy("key").agg(*mins)
    return found.select("key", F.array(*[f"h{i}" for i in range(first, first + hashes)]).alias("sig"))


def band_keys(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, band, rows) with the exact slice of the signature as bucket."""
    return sigs.select("key", F.explode(minhash.bands(F.col("sig"), bands, rows)).alias("b")).select("key", "b.band", "b.rows")


def candidates(buckets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (k1, k2), k1 < k2, of keys that share a bucket."""
    return common_members(buckets.select("key", F.struct("band", "rows").alias("member")), block=block).select("k1", "k2")


def lsh_pairs(
    inc: DataFrame,
    threshold: float = 0.05,
    family: minhash.HashFamily = minhash.HashFamily(),
    hashes: int = 50,
    bands: int = 50,
    first: int = 1,
) -> DataFrame:
    """(k1, k2, sim): the pairs that share a MinHash bucket and have a Jaccard >= `threshold` > 0.

    Single-row bands make candidates of far more pairs than share a member, so common members are counted first, in blocks,
    and the buckets of the pairs at the threshold are compared where they are counted. With `first` 0 and one row a band, the
    first band would hold every key in one bucket: the result is that of `exact_pairs`, which is taken instead.
    """
    if hashes % bands:
        raise ValueError("the number of bands must divide the number of hashes")
    if first == 0 and hashes == bands:
        return exact_pairs(inc, threshold)
    rows = cut(inc.select("key", "member").where("key IS NOT NULL AND member IS NOT NULL").distinct(), "incidence")
    table, count = blocks.packed(rows)
    sigs = signatures(rows, family, hashes, first).select("key", F.col("sig").cast("array<int>").alias("sig"))
    found = blocks.counted(table.join(sigs, "key"), count, near=float(threshold), bands=bands)
    return _reaching(found, threshold).select("k1", "k2", "sim")
