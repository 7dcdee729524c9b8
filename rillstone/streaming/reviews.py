"""The review table as a stream: deliveries come in order of arrival, repeated ones drop out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.text import blank_to_null

DELIVERY_SCHEMA = "review_id string, user_id string, business_id string, stars double, text string, date string, loaded_at timestamp"


def read_deliveries(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over the Parquet files that arrive in `folder`."""
    return spark.readStream.schema(DELIVERY_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_deliveries(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first delivery of each review; copies that come up to `delay` later drop out, state beyond that is freed."""
    named = stream.withColumns({c: blank_to_null(c) for c in ("review_id", "user_id", "business_id")})
    return named.where("review_id IS NOT NULL AND loaded_at IS NOT NULL").withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["review_id"])


def rating_windows(reviews: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, item, reviews, rated, mean): reviews of each business by arrival, once a window is past the watermark."""
    found = reviews.where("business_id IS NOT NULL").groupBy(F.window("loaded_at", width), F.col("business_id").alias("item"))
    return found.agg(F.count(F.lit(1)).alias("reviews"), F.count("stars").alias("rated"), F.avg("stars").alias("mean")).select(
        F.col("window.start").alias("start"), "item", "reviews", "rated", "mean"
    )
