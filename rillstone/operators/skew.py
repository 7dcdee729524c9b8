"""Per-key work without imbalance: fragment-replicate by estimated load.

Keys are counted (combined before the shuffle), packed into tasks of about equal load, and rows are sent to their task by
number. A key with more than a task's share of rows is split into shards in proportion to its load; the matching side of
a join is repeated only to the tasks that hold shards of a key. What reaches the driver is bounded by the number of
tasks: at most 4 heavy keys and 8 hash buckets per task; both go out as small broadcast tables.

Null keys match nothing and form no group; they are spread over the tasks. Repeated rows stay repeated.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.plans.cut import cut

HEAVY_PER_TASK = 4
BUCKETS_PER_TASK = 8


@dataclass(frozen=True)
class TaskPlan:
    """Where rows go: `heavy` has the tasks of each heavy key's shards, `buckets` the task of each hash bucket."""

    tasks: int
    heavy: list[tuple[object, list[int]]]
    buckets: list[int]
    loads: list[float]
    key_type: str
    rows: int


def key_loads(df: DataFrame, key: str) -> DataFrame:
    """(key, rows) of every key, and of the null key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pack(heavy: list[tuple[object, int]], buckets: list[int], tasks: int) -> tuple[list[tuple[object, list[int]]], list[int], list[float]]:
    """Largest first into the least loaded task. A key above a task's share is split into equal shards within it."""
    target = max(1.0, (sum(n for _, n in heavy) + sum(buckets)) / tasks)
    pieces = []
    for at, (_, n) in enumerate(heavy):
        shards = min(tasks, max(1, -int(-n // target)))
        pieces += [(n / shards, 0, at)] * shards
    pieces += [(float(n), 1, at) for at, n in enumerate(buckets)]
    free = [(0.0, t) for t in range(tasks)]
    owner: list[list[int]] = [[] for _ in heavy]
    of_bucket = [0] * len(buckets)
    for n, kind, at in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        load, t = heapq.heappop(free)
        heapq.heappush(free, (load + n, t))
        if kind:
            of_bucket[at] = t
        else:
            owner[at].append(t)
    return [(k, sorted(o)) for (k, _), o in zip(heavy, owner)], of_bucket, [x for x, _ in sorted(free, key=lambda f: f[1])]


def plan_tasks(df: DataFrame, key: str, tasks: int | None = None) -> TaskPlan:
    """Counts the keys of `df` and packs them into `tasks` tasks (default: the session's shuffle partitions)."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = cut(key_loads(df, key), "loads")
    rows = every.agg(F.sum("rows")).first()[0] or 0
    loads = every.where("key IS NOT NULL")
    count = BUCKETS_PER_TASK * tasks
    least = max(1, rows // (HEAVY_PER_TASK * tasks))
    heavy = [(r.key, r["rows"]) for r in loads.where(F.col("rows") > least).orderBy(F.col("rows").desc(), "key").collect()]
    by_bucket = dict(loads.where(F.col("rows") <= least).groupBy(_bucket(F.col("key"), count)).agg(F.sum("rows")).collect())
    placed, buckets, packed = pack(heavy, [by_bucket.get(b, 0) for b in range(count)], tasks)
    return TaskPlan(tasks, placed, buckets, packed, df.schema[key].dataType.simpleString(), rows)


def _with_targets(df: DataFrame, key: str, plan: TaskPlan) -> DataFrame:
    """Adds the tasks of a heavy key's shards and the task of the key's bucket, in columns whose names begin with `__skew_`."""
    spark = df.sparkSession
    table = spark.createDataFrame(plan.heavy, f"__skew_key {plan.key_type}, __skew_tasks array<int>")
    buckets = spark.createDataFrame(list(enumerate(plan.buckets)), "__skew_bucket int, __skew_task int")
    placed = df.join(F.broadcast(table), F.col(key) == F.col("__skew_key"), "left").drop("__skew_key")
    return placed.withColumn("__skew_bucket", _bucket(F.col(key), len(plan.buckets))).join(F.broadcast(buckets), "__skew_bucket", "left").drop("__skew_bucket")


def scatter(df: DataFrame, key: str, plan: TaskPlan, spread: Column | None = None) -> DataFrame:
    """Sends each row to one task, in the column `__skew_task`: a heavy key's rows to its shards by `spread` (default: a hash of the row).

    `spread` must be the same whenever a row is computed again, and should differ between the rows of a key.
    """
    salt = F.pmod(spread if spread is not None else F.xxhash64(*df.columns), F.lit(1 << 30)).cast("int")
    sent = _with_targets(df.withColumn("__skew_salt", salt), key, plan)
    at = F.when(F.col("__skew_tasks").isNotNull(), F.element_at("__skew_tasks", F.col("__skew_salt") % F.size("__skew_tasks") + 1)).when(F.col(key).isNull(), F.col("__skew_salt") % plan.tasks).otherwise(F.col("__skew_task"))
    return sent.withColumn("__skew_task", at).drop("__skew_tasks", "__skew_salt").repartitionById(plan.tasks, F.col("__skew_task"))


def replicate(df: DataFrame, key: str, plan: TaskPlan) -> DataFrame:
    """Sends each row to every task that holds a shard of its key."""
    sent = _with_targets(df.where(F.col(key).isNotNull()), key, plan)
    all_of = F.coalesce(F.array_distinct("__skew_tasks"), F.array("__skew_task"))
    return sent.withColumn("__skew_task", F.explode(all_of)).drop("__skew_tasks").repartitionById(plan.tasks, F.col("__skew_task"))


def balanced_join(big: DataFrame, match: DataFrame, key: str, how: str = "inner", plan: TaskPlan | None = None, spread: Column | None = None) -> DataFrame:
    """Joins `match` to `big` on `key` ('inner' or 'left'), every task with about the same number of rows of `big`.

    The columns of both sides stay; where a name other than the key occurs in both, that of `match` gets the ending
    `_match`, as often as needed. Names beginning with `__skew_` are reserved. Both sides are placed by task number, and
    the join adds no exchange of its own. With 'left', rows with a null key stay and match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    plan = plan or plan_tasks(big, key)
    twice, taken = {}, {*big.columns, *match.columns}
    for c in match.columns:
        if c in big.columns and c != key:
            name = f"{c}_match"
            while name in taken:
                name += "_match"
            twice[c] = name
            taken.add(name)
    left = scatter(big, key, plan, spread)
    right = replicate(match.withColumnsRenamed(twice), key, plan)
    return left.join(right, ["__skew_task", key], how).drop("__skew_task")


def balanced_aggregate(df: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], plan: TaskPlan | None = None, spread: Column | None = None) -> DataFrame:
    """Aggregates by `key` in two steps: `partial` within each task, `final` over the partial columns of a key.

    A heavy key is aggregated in as many tasks as it has shards; the second step sees one row per key and task. The
    result has `key` and the columns of `final`; null keys form no group.
    """
    plan = plan or plan_tasks(df, key)
    sent = scatter(df.where(F.col(key).isNotNull()), key, plan, spread)
    parts = sent.groupBy("__skew_task", key).agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def heavy_keys(df: DataFrame, key: str, least_share: float, plan: TaskPlan | None = None) -> DataFrame:
    """(key, rows, share) of the keys that hold at least `least_share` of all rows, rows with a null key included.

    The least number of rows is taken as an exact decimal product, so a key exactly at the limit is in.
    """
    plan = plan or plan_tasks(df, key)
    total = plan.rows
    found = balanced_aggregate(df.select(key), key, {"n": F.count(F.lit(1))}, {"rows": F.sum("n")}, plan, F.monotonically_increasing_id())
    limit = F.lit(str(least_share)).cast("decimal(20,10)") * F.lit(total).cast("decimal(18,0)")
    return found.where(F.col("rows") >= limit).select(F.col(key).alias("key"), "rows", F.round(F.col("rows") / F.lit(max(total, 1)), 6).alias("share"))
