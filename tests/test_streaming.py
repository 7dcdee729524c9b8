from datetime import datetime, timedelta

from rillstone.streaming import reviews

from .conftest import rows, table


def test_copies_drop_out_and_windows_close(spark, tmp_path):
    start = datetime(2020, 1, 1)
    first = [("r1", "u", "b ", 4.0, 0), (" r1", "u", "b", 4.0, 3), ("r2", "", "b", None, 5), (None, "u", "b", 1.0, 5), ("r3", "u", "c", 2.0, 24 * 9)]
    data = [(r, u, b, s, None, None, start + timedelta(hours=h)) for r, u, b, s, h in first]
    folder = str(tmp_path / "in")
    table(spark, data, reviews.DELIVERY_SCHEMA).coalesce(1).write.parquet(folder)
    found = reviews.rating_windows(reviews.distinct_deliveries(reviews.read_deliveries(spark, folder)))
    query = found.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        table(spark, [("r4", "u", "c", 1.0, None, None, start + timedelta(days=30))], reviews.DELIVERY_SCHEMA).write.mode("append").parquet(folder)
        query.processAllAvailable()
        got = rows(spark.table("windows"), "item", "reviews", "rated", "mean")
    finally:
        query.stop()
    assert ("b", 2, 1, 4.0) in got and all(r[0] in ("b", "c") for r in got)
