"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(items: DataFrame, group: list[str], score: str, identifier: str, n: int) -> DataFrame:
    """The n rows of each group with the highest `score`, ties by the smaller `identifier`; null scores come last.

    A rank filter over a `row_number` window: the optimiser limits each group before and after the shuffle, so a task
    receives at most n rows of a group from each task before it. Rows equal in both columns are all candidates.
    """
    order = W.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(identifier))
    rank = "rank"
    while rank in items.columns:
        rank += "_"
    return items.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n).drop(rank)
