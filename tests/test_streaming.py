import uuid

from corpuslens.streaming.windows import deduplicated, read_feed, run_available, tumbling


def test_feed_is_deduplicated(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/chunk_records.parquet").select("received_at", "collection", "chunk_id").filter("received_at is not null")
    src = src.withColumn("received_at", src["received_at"].cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "feed"))
    out = str(tmp_path / "out")
    s = deduplicated(read_feed(spark, str(tmp_path / "feed"), src.schema, 10), "3650 days")
    run_available(s, lambda df, _: df.write.mode("append").parquet(out), uuid.uuid4().hex)  # a checkpoint of its own
    assert spark.read.parquet(out).count() == src.select("collection", "chunk_id").distinct().count()


def test_same_windows_in_batch_and_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.withColumn("ts", e["ts"].cast("timestamp"))
    e.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = tumbling(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.window_start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("win")) == key(tumbling(e))
