"""Problem 10: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.abuse import score_documents, source_rates
from corpuslens.sources.tables import load


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document; over 0 is abusive."""
    return score_documents(load(spark, d, "documents"), load(spark, d, "moderation_labels")).select(
        "doc_id", F.round("score", 4).alias("score"), "abusive")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one abusive passage."""
    return p10_scores(spark, d).filter("abusive").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of abusive documents by source."""
    return source_rates(score_documents(load(spark, d, "documents"), load(spark, d, "moderation_labels")))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
