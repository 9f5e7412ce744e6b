"""Problems 8 (encoding) and 9 (mixing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.mixing import mix
from corpuslens.llm.tokens import count_tokens, decode, encode
from corpuslens.sources.tables import load


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the decoded ids are the text again, by document."""
    e = decode(encode(load(spark, d, "documents").select("doc_id", "text")))
    return e.select("doc_id", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and documents by source."""
    e = count_tokens(load(spark, d, "documents").select("source", "text"))
    return e.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Chosen documents of each mix with their repeats."""
    return mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p8_counts": p8_counts, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
