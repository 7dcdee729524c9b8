"""Frequency of every distinct term: an external sort of (term, record) pairs, merged by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.terms import merge_runs, sorted_runs
from rillstone.plans.cut import cut

COMMON_SHARE = 0.1
RARE_MOST = 2


def term_frequencies(records: DataFrame, text: str = "text", common_share: float = COMMON_SHARE, rare_most: int = RARE_MOST) -> DataFrame:
    """(term, occurrences, records, mark) of every term in `records`, one row of which is one record.

    Each block of records is sorted into a run of (term, record) pairs and scanned by run length; the runs are
    range-partitioned by (term, block), sorted, and scanned again. A term that fills several ranges is added up at the
    end, so no term is too common for a task. `mark` is 'common' if at least `common_share` of all records, those without
    text included, hold the term, else 'rare' if at most `rare_most` do, else null. No records give an empty result.
    """
    runs = cut(records.select(text).mapInArrow(sorted_runs(text), "term string, block long, records long, occurrences long"), "runs")
    total = runs.where("term IS NULL").agg(F.sum("records")).first()[0] or 0
    ranged = runs.where("term IS NOT NULL").repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    parts = ranged.mapInArrow(merge_runs, "term string, records long, occurrences long")
    found = parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    share = F.lit(str(common_share)).cast("decimal(20,10)") * F.lit(total).cast("decimal(18,0)")
    mark = F.when(F.col("records") >= share, F.lit("common")).when(F.col("records") <= rare_most, F.lit("rare"))
    return found.withColumn("mark", mark)
