from pyspark.sql import functions as F

from hyperstrata.streaming import running


def test_windowed_feed(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value").repartition(2).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = running.binned_feed(feed, "ts", "value", "event_type", "1 day", "60 days").writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event_type"], r["n"], round(r["total"], 6)) for r in spark.sql("SELECT * FROM bins").collect()}
    batch = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()
    assert got == {(r["event_type"], r["n"], round(r["total"], 6)) for r in batch}
