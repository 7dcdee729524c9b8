"""How distinctive a term is of a record: log-odds with an informative Dirichlet prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.plans.cut import cut
from rillstone.plans.spread import ROWS, hot_groups, spread_join

PRIOR_WORDS = 1000.0


def distinctive_terms(counts: DataFrame, prior_words: float = PRIOR_WORDS, least: int = 1) -> DataFrame:
    """(gid, term, k, n, d, z) for the terms that occur at least `least` times in a record.

    `counts` has `gid`, `term` and `n`, the occurrences. k are the term's occurrences in the record, n the record's words, d
    the records that hold the term. z is the log-odds ratio of the record against the rest, smoothed by a Dirichlet prior
    of `prior_words` words spread as in the collection, over its standard error. Statistics cover all records, whatever
    `least` is. A collection of one term or of one record gives finite scores. A term that many records hold meets its
    statistics in parts.
    """
    counts = cut(counts.select("gid", "term", F.col("n").alias("k")), "counts")
    sizes = counts.groupBy("gid").agg(F.sum("k").alias("n"))
    terms = cut(counts.groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("k").alias("all")), "terms")
    pairs, total = terms.agg(F.sum("d"), F.sum("all").cast("double")).first()
    hot = hot_groups(terms, ["term"], "d", ROWS, pairs or 0)
    total = total or 0.0
    scored = spread_join(counts.where(F.col("k") >= least), terms, ["term"], hot, "gid").join(sizes, "gid")
    prior = F.col("all") * F.lit(prior_words / max(total, 1.0))

    def log_odds(y, words):
        return F.ln(y + prior) - F.ln(F.greatest(words + F.lit(prior_words) - y - prior, F.lit(1e-9)))

    rest = F.col("all") - F.col("k")
    gap = log_odds(F.col("k"), F.col("n")) - log_odds(rest, F.lit(total) - F.col("n"))
    error = F.sqrt(1 / (F.col("k") + prior) + 1 / (rest + prior))
    return scored.select("gid", "term", "k", "n", "d", (gap / error).alias("z"))
