"""Window counts and deduplicated feeds: one transformation for batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import shared_dir


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("session_start"), "n")


def deduplicated(feed: DataFrame, late: str = "30 days") -> DataFrame:
    """Redelivered chunks once within the watermark."""
    return feed.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["collection", "chunk_id"])


def read_feed(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], name: str, seconds: int | None = None) -> None:
    """Works off what is there in micro batches, with a checkpoint in the shared folder.

    seconds: the fetch budget; a batch that runs is finished, the rest is left for the next call.
    """
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}").trigger(availableNow=True).start()
    if not q.awaitTermination(seconds) if seconds else q.awaitTermination():
        q.stop()
