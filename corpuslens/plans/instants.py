"""Queries of problem 4: creation times as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.instants import resolve_instants
from corpuslens.sources.tables import load


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    cols = ["record_no", "collection", "chunk_id", "metadata", "received_at"]
    return resolve_instants(load(spark, d, "chunk_records").select(*cols), load(spark, d, "collection_settings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One UTC instant for each row that has one."""
    return _resolved(spark, d).filter(F.col("utc_us").isNotNull()).select("record_no", "utc_us")


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    """Rows by collection and origin of their instant, with those left ambiguous."""
    return _resolved(spark, d).groupBy("collection", "instant_source").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("ambiguous").cast("int")).alias("n_ambiguous"))


QUERIES = {"p4_found": p4_found, "p4_sources": p4_sources}
SQL: dict[str, str] = {}
