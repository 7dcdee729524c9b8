"""Dense numbers in the order of a column, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillstone.plans.cut import cut


def numbered(df: DataFrame, column: str, name: str = "number", first: int = 0) -> DataFrame:
    """`df`, whose values of `column` differ, with dense numbers from `first` on in the order of `column`.

    Rows are numbered within ranges, and only the sizes of the ranges meet in one place. The placed rows are written, so
    that a task that runs again can't see other ranges than the sizes were counted from.
    """
    ranged = df.repartitionByRange(column).sortWithinPartitions(column)
    placed = cut(ranged.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at")), "placed")
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__start"))
    before = sizes.select("__range", "__start", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))
    number = F.col("__at") - F.col("__start") + F.col("__before") + F.lit(first)
    return placed.join(F.broadcast(before), "__range").withColumn(name, number).drop("__range", "__at", "__start", "__before")
