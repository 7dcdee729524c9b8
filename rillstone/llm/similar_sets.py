"""All similar pairs of set-valued records by recursive chosen-path splitting.

In every tree a record follows, at each node, those of its tokens whose hash for that node is below branch / size: similar
records meet because the choice depends on the token, not on the record. Nodes that have become small are compared by
brute force, with a filter on sizes and on 32 one-byte MinHash values; the pairs of all trees are verified exactly.

Recall. Records of J >= t share at least t n tokens, n being the larger size, so at a node with a path of L tokens they
share t n - L more at least, and a token is followed with probability branch t / (t n - L). The branch is 2 / t (4 at
t = 0.5, and never less than that), so a pair parts at a node with probability at most e^-2, at any depth and threshold.
Over three levels a tree finds a pair with probability 0.64 at least, and eight trees miss it with less than 0.0003 (one
level: 1e-7); over all six levels they find it with 0.987 at least. Where t n - L is at most branch t, all tokens are
followed. A pair that shares no token beside the path has J >= t only if t (n1 + n2) <= (1 + t) L; such pairs
are taken at the node itself, before it is split. The MinHash filter asks for as many of 32 equal bytes (5 at t = 0.5) as
a pair of J = t misses with probability 1e-5 at most.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.setsim import count_pairs
from rillstone.plans.cut import cut

TREES = 8
BRANCH = 4.0
LEAF = 100
DEPTH = 6
SKETCH = 32
FOLLOWED = 2.0
MISSED = 1e-5


def _uniform(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def _equal_bytes(a: str, b: str) -> Column:
    """Equal bytes of two packed sketches."""
    total = F.lit(SKETCH)
    for w in range(SKETCH // 8):
        x = F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def least_equal(threshold: float) -> int:
    """The most equal bytes that can be asked for so that a pair of Jaccard `threshold` is dropped with chance `MISSED` at most.

    A byte agrees with chance t at least, so their number is at least that of a binomial distribution.
    """
    tail, k = 0.0, 0
    while tail + math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k) <= MISSED and k < SKETCH:
        tail += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        k += 1
    return k


def describe_sets(edges: DataFrame, least: int) -> DataFrame:
    """(key, n, f1, f2, s0..): size, fingerprint and packed MinHash of every set, all combined before the shuffle."""
    token = F.xxhash64("member")
    mins = [F.min(F.xxhash64(token, F.lit(i))).alias(f"m{i}") for i in range(SKETCH)]
    sums = edges.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(token).alias("f1"), F.bit_xor(F.xxhash64(token, F.lit("f2"))).alias("f2"), *mins
    )
    word = lambda w: reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"m{8 * w + j}").bitwiseAND(F.lit(255)), 8 * j) for j in range(8)])
    packed = [word(w).alias(f"s{w}") for w in range(SKETCH // 8)]
    return sums.where(F.col("n") >= least).select("key", "n", "f1", "f2", *packed)


def set_classes(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep, n, s0..) of every distinct set and (key, id) of the records that have it.

    Equal sets have equal size and equal 128-bit fingerprints. The copies of a set are one record from here on.
    """
    sets = cut(describe_sets(edges, least), "sets")
    packed = [f"s{w}" for w in range(SKETCH // 8)]
    one = sets.groupBy("n", "f1", "f2", *packed).agg(F.min("key").alias("rep"))
    classes = cut(one.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = sets.join(classes.select("n", "f1", "f2", "id"), ["n", "f1", "f2"]).select("key", "id")
    return classes.select("id", "rep", "n", *packed), members


def _sized(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "node")


def used_up_pairs(rows: DataFrame, threshold: float, leaf: int) -> DataFrame:
    """(a, b) of the records of one node that are similar by the `shared` tokens of its path alone.

    `rows` has node, shared, id and n. Sizes n1 <= n2 with t (n1 + n2) <= (1 + t) shared suffice, so no pair is compared in
    vain; the smaller records of a node go in blocks of `leaf`.
    """
    rows = cut(rows.distinct(), "used")
    most = F.floor(F.col("shared") * F.lit((1 + threshold) / threshold) - F.col("n") + F.lit(1e-9))
    small = rows.withColumn("most", most).where("n <= most")
    left = small.select("node", "shared", F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.sequence("n", "most")).alias("nb"))
    on = ["node", "shared", "nb"]
    parts = left.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("parts"))
    left = left.join(parts, on).withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    right = rows.select("node", "shared", F.col("id").alias("b"), F.col("n").alias("nb")).join(parts, on)
    right = right.select(*on, "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, [*on, "part"]).where("na < nb OR a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def chosen_path_pairs(records: DataFrame, edges: DataFrame, threshold: float, trees: int = TREES, branch: float = BRANCH, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Distinct (a, b), a < b, of record ids that meet in a leaf and pass the filters on size and sketch.

    `records` has id, n and the sketch, `edges` (id, n, token). A node with more than `leaf` records is split again, with
    new random choices among the tokens that aren't on its path; pairs that may share none of these are taken before.
    Nodes still larger at the last level are compared in blocks of `leaf` records, each block against all: no pair of
    them is given up.
    """
    packed = [f"s{w}" for w in range(SKETCH // 8)]
    rest = lambda on_path: F.greatest(F.col("n") * F.lit(float(threshold)) - F.lit(float(on_path)), F.lit(1.0))
    choice = lambda on_path, *c: _uniform(*c) < F.lit(branch * threshold) / rest(on_path)
    nodes = (
        edges.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees))))
        .where(choice(0, F.col("token"), F.col("tree")))
        .select(F.xxhash64("tree", "token").alias("node"), F.array("token").alias("path"), "id", "n")
    )
    leaves, used = [], []
    for level in range(depth):
        sized = cut(_sized(nodes), f"level{level}")
        last = level == depth - 1
        leaves.append(sized if last else sized.where(F.col("size") <= leaf))
        large = sized.where(F.col("size") > leaf)
        if last or large.isEmpty():
            break
        # Trees and orders that lead to the same tokens have the same pairs of this kind.
        ending = large.where(F.col("n") * F.lit(float(threshold)) <= F.lit(level + 1 + 1e-9))
        used.append(ending.select(F.xxhash64(F.array_sort("path")).alias("node"), F.lit(level + 1).alias("shared"), "id", "n"))
        nodes = (
            large.drop("n").join(edges, "id")
            .where(~F.array_contains("path", F.col("token")) & choice(level + 1, F.col("token"), F.col("node")))
            .select(F.xxhash64("node", "token").alias("node"), F.array_append("path", F.col("token")).alias("path"), "id", "n")
        )
    rows = reduce(DataFrame.unionByName, [x.select("node", "id", "size") for x in leaves]).join(records.select("id", "n", *packed), "id")
    parts = rows.withColumn("parts", F.ceil(F.col("size") / leaf).cast("int"))
    left = parts.select("node", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("na"), *[F.col(s).alias(f"a{s[1:]}") for s in packed])
    right = parts.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), *[F.col(s).alias(f"b{s[1:]}") for s in packed])
    near = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(float(threshold))) & (_equal_bytes("a", "b") >= least_equal(threshold))
    pairs = left.join(right, ["node", "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    if used:
        pairs = pairs.unionByName(used_up_pairs(reduce(DataFrame.unionByName, used), threshold, leaf))
    return pairs.distinct()


def similar_sets(inc: DataFrame, threshold: float = 0.5, least: int = 3, other: DataFrame | None = None, trees: int = TREES, branch: float | None = None, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar sets, as (a, b, sim) between classes of equal sets and (key, id) membership.

    `inc` has `key` and `member`; nulls drop out, repeated rows count once, sets of fewer than `least` members are left
    out. A class pairs with itself (a = b, sim 1) if it has several records. With `other`, a second incidence, only pairs
    of a record of `inc` and one of `other` come out, and membership has the column `side`, 1 or 2. Similarity is the
    exact Jaccard of the members' values, compared as a fraction.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    branch = branch or max(BRANCH, FOLLOWED / threshold)
    clean = lambda df: df.select("key", "member").where("key IS NOT NULL AND member IS NOT NULL").distinct()
    if other is None:
        edges = cut(clean(inc), "edges")
    else:
        side = lambda df, s: clean(df).select(F.struct(F.lit(s).alias("side"), F.col("key").cast("string").alias("key")).alias("key"), "member")
        edges = cut(side(inc, 1).unionByName(side(other, 2)), "edges")
    records, members = set_classes(edges, least)
    if other is not None:
        members = members.select("key.side", F.col("key.key").alias("key"), "id")
    tokens = cut(edges.join(records.select(F.col("rep").alias("key"), "id", "n"), "key").select("id", "n", "member", F.xxhash64("member").alias("token")), "tokens")
    found = cut(chosen_path_pairs(records, tokens.select("id", "n", "token"), threshold, trees, branch, leaf, depth), "candidates")
    if other is not None:
        sides = members.groupBy("id").agg(F.bit_or(F.col("side")).alias("sides"))
        x, y = (sides.select(F.col("id").alias(k), F.col("sides").alias(f"s_{k}")) for k in ("a", "b"))
        found = found.join(x, "a").join(y, "b").where(F.col("s_a").bitwiseOR(F.col("s_b")) == 3).select("a", "b")
    sized = lambda i, k: records.select(F.col("id").alias(k), F.col("n").alias(f"n{i}"))
    pairs = found.join(sized(1, "a"), "a").join(sized(2, "b"), "b").withColumnsRenamed({"a": "id1", "b": "id2"})
    common = count_pairs(pairs, tokens)
    union = F.col("n1") + F.col("n2") - F.col("c")
    pairs = common.where(F.col("c") >= F.lit(float(threshold)) * union).select(F.col("id1").alias("a"), F.col("id2").alias("b"), (F.col("c") / union).alias("sim"))
    grouped = members.groupBy("id").agg(F.count(F.lit(1)).alias("records"), *([F.countDistinct("side").alias("sides")] if other is not None else []))
    itself = grouped.where("sides > 1" if other is not None else "records > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    return pairs.unionByName(itself), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(k1, k2, sim), k1 < k2, of the records behind pairs of classes within one table."""
    one, two = (members.select(F.col("id").alias(i), F.col("key").alias(k)) for i, k in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(two, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2"), "sim")
