"""Hot groups: which ones there are, and joins that split them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 100_000
ROWS = 100_000


def hot_groups(sizes: DataFrame, by: list[str], count: str, block: int, total: int, most: int = MOST_HOT) -> DataFrame | None:
    """(by, __parts) of the groups with more than `block` rows, in parts of `block` rows; None where none can be as large.

    `sizes` has one row per group, `total` is the number of all rows. A group must also exceed `total` / `most` rows, so
    there are at most `most` of them at any size of the data, and the table is marked for broadcast.
    """
    least = max(block, total // most)
    if total <= least:
        return None
    hot = sizes.where(F.col(count) > least)
    return F.broadcast(hot.select(*by, F.ceil(F.col(count) / block).cast("int").alias("__parts")))


def split(df: DataFrame, by: list[str], hot: DataFrame | None, *spread: str) -> DataFrame:
    """Adds `__part`: which part of its group a row is in, by a hash of the columns `spread`; 0 in groups that aren't hot."""
    if hot is None:
        return df.withColumn("__part", F.lit(0))
    part = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), "__parts").cast("int"))
    return df.join(hot, by, "left").withColumn("__part", part).drop("__parts")


def repeat(df: DataFrame, by: list[str], hot: DataFrame | None) -> DataFrame:
    """Adds `__part` with one row for each part of the row's group."""
    if hot is None:
        return df.withColumn("__part", F.lit(0))
    marked = df.join(hot, by, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    return marked.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")


def spread_join(big: DataFrame, small: DataFrame, by: list[str], hot: DataFrame | None, *spread: str, how: str = "inner") -> DataFrame:
    """`big` with the rows of `small`, hot groups of `big` in parts; `small` is repeated for the parts of hot groups only."""
    if hot is None:
        return big.join(small, by, how)
    return split(big, by, hot, *spread).join(repeat(small, by, hot), [*by, "__part"], how).drop("__part")
