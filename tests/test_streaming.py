from pyspark.sql import functions as F

from siltstone.streaming import events as E


def test_windowed_counts(spark, sf, tmp_path):
    src = f"{tmp_path}/events"
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(src)
    q = E.windowed_counts(E.stream_of(spark, src, 4), "1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(src).groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").count()
    assert {(r.start, r.event_type, r.n) for r in spark.table("daily").collect()} == {(r.start, r.event_type, r["count"]) for r in batch.collect()}


def test_maintained_counts(spark, sf, tmp_path):
    src, kept = f"{tmp_path}/events", {}
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(src)
    schema = "user_id long, event_type string, n long, batch long"
    read = lambda: spark.createDataFrame(kept["rows"], schema) if kept else None
    q = E.maintained_counts(E.stream_of(spark, src), ["user_id", "event_type"], "counts", read, lambda df: kept.update(rows=df.collect())).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    whole = spark.read.parquet(src).groupBy("user_id", "event_type").count()
    assert {(r.user_id, r.event_type, r.n) for r in kept["rows"]} == {tuple(r) for r in whole.collect()}
