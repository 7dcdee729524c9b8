"""The review tables: explicit schemas, trimmed ids, one row per review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.text import blank_to_null

REVIEW_SCHEMA = "review_id string, user_id string, business_id string, stars double, text string, date string"
STOPWORD_BOUND = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_ndjson(spark: SparkSession, path: str, schema: str = REVIEW_SCHEMA) -> DataFrame:
    """One JSON object per line under a fixed schema: no pass for inference, a missing field is null."""
    return spark.read.schema(schema).json(path)


def read_ndjson_as_text(spark: SparkSession, path: str, schema: str = REVIEW_SCHEMA) -> DataFrame:
    """As `read_ndjson`, but a damaged line stays visible: it comes as a row of nulls."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def distinct_reviews(raw: DataFrame, *columns: str) -> DataFrame:
    """One row per distinct trimmed `review_id`, with trimmed `user_id` and `business_id` and the columns asked for.

    Copies of a review are combined before the shuffle, so a review delivered millions of times is no hot group. Where
    copies disagree the smallest value counts, column by column; nulls lose against values. Rows without a review id
    are no reviews and drop out.
    """
    ids = [c for c in ("user_id", "business_id") if c in columns]
    rest = [c for c in columns if c not in ids]
    trimmed = raw.select(
        blank_to_null("review_id").alias("review_id"), *[blank_to_null(c).alias(c) for c in ids], *[F.col(c) for c in rest]
    ).where(F.col("review_id").isNotNull())
    return trimmed.groupBy("review_id").agg(*[F.min(c).alias(c) for c in columns])


def ratings(raw: DataFrame) -> DataFrame:
    """(user, item, stars) of every review that has a user and a business; reviews of one place by one user all stay.

    Null stars stay null, values outside 1 to 5 stay as they are.
    """
    return (
        distinct_reviews(raw, "user_id", "business_id", "stars")
        .where(F.col("user_id").isNotNull() & F.col("business_id").isNotNull())
        .select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), "stars")
    )


def reviewed(raw: DataFrame) -> DataFrame:
    """(user, item) of every row that is a review with both, for uses that don't count reviews: copies of a review name the
    same pair, so rows needn't be combined by review first."""
    named = raw.where(blank_to_null("review_id").isNotNull()).select(blank_to_null("user_id").alias("user"), blank_to_null("business_id").alias("item"))
    return named.where("user IS NOT NULL AND item IS NOT NULL")


def documents(raw: DataFrame, *columns: str) -> DataFrame:
    """(item, columns): one row per review of a business; texts are not concatenated, counts add up instead."""
    return (
        distinct_reviews(raw, "business_id", *columns)
        .where(F.col("business_id").isNotNull())
        .select(F.col("business_id").alias("item"), *columns)
    )


def stopwords(raw: DataFrame) -> list[str]:
    """The distinct stop words, trimmed and in lower case. A list of words of a language is small; its size is checked."""
    words = raw.select(F.lower(F.regexp_replace("word", r"^\s+|\s+$", "")).alias("word")).where("word <> ''").distinct()
    found = [r.word for r in words.limit(STOPWORD_BOUND + 1).collect()]
    if len(found) > STOPWORD_BOUND:
        raise ValueError(f"more than {STOPWORD_BOUND} stop words")
    return sorted(found)


def read_stopwords(spark: SparkSession, path: str) -> list[str]:
    """Stop words from a text file with one word per line."""
    return stopwords(spark.read.text(path).withColumnRenamed("value", "word"))


def test_pairs(raw: DataFrame) -> DataFrame:
    """(user, item, times) of each pair to score; `times` says how often it repeats. Pairs with a null key drop out."""
    return (
        raw.select(blank_to_null("user_id").alias("user"), blank_to_null("business_id").alias("item"))
        .where(F.col("user").isNotNull() & F.col("item").isNotNull())
        .groupBy("user", "item")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def user_averages(raw: DataFrame) -> DataFrame:
    """(user, avg_stars) as stored; a null average counts as a missing user."""
    return raw.select(blank_to_null("user_id").alias("user"), F.col("avg_stars").cast("double").alias("avg_stars")).where(
        F.col("user").isNotNull() & F.col("avg_stars").isNotNull()
    )


def averages_of(ratings_: DataFrame) -> DataFrame:
    """(user, avg_stars) computed from ratings, where no file of averages is at hand."""
    return ratings_.groupBy("user").agg(F.avg("stars").alias("avg_stars")).where(F.col("avg_stars").isNotNull())


def read_averages(spark: SparkSession, path: str) -> DataFrame:
    """(user, avg_stars) from JSON objects that map users to averages, one object per line; null averages drop out."""
    entries = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,double>")).alias("user", "avg_stars"))
    return entries.select(blank_to_null("user").alias("user"), "avg_stars").where("user IS NOT NULL AND avg_stars IS NOT NULL")
