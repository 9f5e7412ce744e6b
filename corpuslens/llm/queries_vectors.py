"""Problems 1 (clusters) and 3 (most similar vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.clusters import clusters, typical_members
from corpuslens.llm.neighbours import neighbours, pairs_of, search
from corpuslens.sources.tables import load

LINK, SIMILAR, K = 0.82, 0.85, 3


def _records(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunk_records").select("chunk_id", "embedding")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of every cluster of 8 or more records linked at a cosine of 0.82."""
    return clusters(_records(spark, d), "chunk_id", "embedding", LINK).select("cluster_key", F.col("name").alias("chunk_id"))


def p1_typical(spark: SparkSession, d: str) -> DataFrame:
    """Size and three most typical members of each cluster."""
    return typical_members(_records(spark, d), "chunk_id", "embedding", LINK, top=3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which one is among the 3 most similar others of the other, cosine at least 0.85."""
    return pairs_of(neighbours(_records(spark, d), "chunk_id", "embedding", K, SIMILAR))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The up to 3 most similar records of each record with their cosines, at least 0.85."""
    return neighbours(_records(spark, d), "chunk_id", "embedding", K, SIMILAR).select(
        F.col("a").alias("chunk_id"), F.col("b").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    """The 3 most similar records, however far, of the records of every 50th row of the feed, against all."""
    asked = load(spark, d, "chunk_records").filter("record_no % 50 = 0").select("chunk_id", "embedding")
    return search(_records(spark, d), asked, "chunk_id", "embedding", K).select(
        F.col("a").alias("chunk_id"), F.col("b").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


QUERIES = {"p1_found": p1_found, "p1_typical": p1_typical, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_search": p3_search}
SQL: dict[str, str] = {
    "p1_found": """WITH RECURSIVE g AS (SELECT chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunk_records WHERE chunk_id IS NOT NULL AND
          coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) GROUP BY 1),
        l AS (SELECT x.chunk_id AS a, y.chunk_id AS b FROM g x JOIN g y ON x.chunk_id <> y.chunk_id WHERE list_cosine_similarity(x.e, y.e) >= 0.82),
        s AS (SELECT a AS id, a AS t FROM l UNION SELECT a, b FROM l), c(id, t) AS (SELECT id, t FROM s UNION SELECT c.id, l.b FROM c JOIN l ON c.t = l.a),
        k AS (SELECT id, min(t) AS cluster_key FROM c GROUP BY 1)
        SELECT cluster_key, id AS chunk_id FROM k QUALIFY count(*) OVER (PARTITION BY cluster_key) >= 8""",
}
