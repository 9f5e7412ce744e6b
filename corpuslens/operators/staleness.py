"""Staleness of chunks: age, drift from the cluster's centroid, contradictions, supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import scores
from corpuslens.operators import neighbourhood as N


def evidence_counts(contradictions: DataFrame) -> DataFrame:
    """(chunk_id, n): open or confirmed contradictions of each chunk."""
    c = contradictions.filter("user_resolution is null or user_resolution = 'confirmed'")
    return c.select(F.explode(F.array("chunk_a", "chunk_b")).alias("chunk_id")).filter("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n"))


def scored(chunks: DataFrame, centroids: DataFrame, evidence: DataFrame, superseded: DataFrame, half_lives: DataFrame, now: Column) -> DataFrame:
    """chunks plus score, label and components.

    chunks: chunk_id, cluster_id, collection, embedding, resolved_timestamp; centroids: cluster_id,
    centroid; evidence: chunk_id, n; superseded: chunk_id; half_lives: collection, half_life_days.
    A chunk without time has no age, without cluster or vector no drift.
    """
    j = chunks.join(centroids.select("cluster_id", "centroid"), "cluster_id", "left").withColumn("_drift", N.drift(F.col("embedding"), F.col("centroid"))).drop("centroid")
    j = j.join(evidence.select("chunk_id", F.col("n").alias("_n")), "chunk_id", "left").join(
        superseded.select("chunk_id").distinct().withColumn("_sup", F.lit(1.0)), "chunk_id", "left").join(half_lives, "collection", "left")
    age = scores.age_decay(F.col("resolved_timestamp"), now, F.coalesce("half_life_days", F.lit(scores.HALF_LIFE)))
    ev, sup = scores.evidence(F.col("_n")), F.coalesce("_sup", F.lit(0.0))
    parts = F.struct(age.alias("age_decay"), F.col("_drift").alias("cluster_drift"), ev.alias("contradiction_evidence"), sup.alias("supersession_evidence"))
    s = F.round(scores.staleness(age, F.col("_drift"), ev, sup), 9)
    return j.withColumn("components", parts).withColumn("score", s).withColumn("label", scores.staleness_label(F.col("score"))).drop("_drift", "_n", "_sup", "half_life_days")
