"""Parquet tables of a data directory and the chunk model built on the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Catalyst prunes its columns and pushes its filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contradictions table, bridged from the pairwise matches: channel gives the detector."""
    m = load(spark, sf_dir, "match_pairs")
    detector = F.when(F.col("channel") == "exact", "nli").when(F.col("channel") == "embedding", "numeric").otherwise("version")
    verdict = F.when(F.col("pair_no") % 5 == 0, "confirmed").when(F.col("pair_no") % 5 == 1, "false_positive")
    return m.select("chunk_a", "chunk_b", detector.alias("detector"), F.col("score").alias("raw_score"),
                    verdict.alias("user_resolution"), "scan_run_id", "pair_no")
