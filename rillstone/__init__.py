"""Set similarity, text profiles, collaborative filtering and skew-safe joins on Spark DataFrames."""
