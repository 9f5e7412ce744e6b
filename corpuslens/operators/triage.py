"""Triage: which chunks may be queries of the expensive pair model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import scores


def priorities(chunks: DataFrame, settings: DataFrame, now: str, parts: bool = False) -> DataFrame:
    """(chunk_id, priority) of clustered active chunks: half age, half relative cluster size; parts: with both as components."""
    c = chunks.filter("deleted_at is null and cluster_id is not null").select("chunk_id", "cluster_id", "collection", "resolved_timestamp")
    size = c.groupBy("cluster_id").agg(F.count("*").alias("n"))
    top = size.agg(F.max("n").alias("m")).withColumn("_1", F.lit(1))
    hl = settings.groupBy("collection").agg(F.max("half_life_days").alias("h"))
    size = size.withColumn("_1", F.lit(1)).join(F.broadcast(top), "_1")  # one row
    age = scores.age_decay(F.col("resolved_timestamp"), F.lit(now).cast("timestamp"), F.coalesce("h", F.lit(scores.HALF_LIFE)))
    j = c.join(size, "cluster_id").join(hl, "collection", "left")
    both = F.struct(F.round(age, 4).alias("age_factor"), F.round(F.col("n") / F.col("m"), 4).alias("cluster_factor")).alias("components")
    return j.select("chunk_id", F.round(scores.priority(age, F.col("n"), F.col("m")), 6).alias("priority"), *([both] if parts else []))


def allowed(scored: DataFrame, budget: int, per_chunk: int) -> DataFrame:
    """The first budget // per_chunk chunks by priority, ties by id: a distributed top-n."""
    return scored.orderBy(F.desc("priority"), "chunk_id").limit(budget // max(per_chunk, 1))
