"""Problems 6 (best representative) and 7 (consolidating matches)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.consolidate import hash_to_min, links_of_groups
from corpuslens.llm.survivors import best_members, survivors
from corpuslens.sources.tables import load


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Per group the member with the best time and the one with the best text."""
    return best_members(load(spark, d, "dedup_groups"), load(spark, d, "chunks"))


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Per group one record built field by field."""
    return survivors(load(spark, d, "dedup_groups"), load(spark, d, "chunks"),
                     ["store_id", "collection", "text", "resolved_timestamp", "timestamp_source", "content_hash", "staleness_label"])


def _links(spark: SparkSession, d: str) -> DataFrame:
    pairs = load(spark, d, "match_pairs").select(F.col("chunk_a").alias("a"), F.col("chunk_b").alias("b"))
    return pairs.unionByName(links_of_groups(load(spark, d, "dedup_groups"), "canonical_chunk_id", "member_chunk_ids"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per linked record with the smallest id of its group."""
    return hash_to_min(_links(spark, d)).select("group_key", F.col("id").alias("chunk_id"))


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size of each group."""
    return p7_found(spark, d).groupBy("group_key").agg(F.count("*").alias("n_members"))


QUERIES = {"p6_found": p6_found, "p6_survivors": p6_survivors, "p7_found": p7_found, "p7_sizes": p7_sizes}

_P7 = """
WITH RECURSIVE g AS (
  SELECT list_distinct(list_filter(list_append(member_chunk_ids, canonical_chunk_id), lambda x: x IS NOT NULL)) AS m FROM dedup_groups),
e0 AS (
  SELECT chunk_a AS a, chunk_b AS b FROM match_pairs WHERE chunk_a IS NOT NULL AND chunk_b IS NOT NULL AND chunk_a <> chunk_b
  UNION SELECT m[1], unnest(m[2:]) FROM g WHERE len(m) > 1),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
r(id, to_id) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.to_id = e.a),
found AS (SELECT least(id, min(to_id)) AS group_key, id AS chunk_id FROM r GROUP BY id)
"""
_P6 = r"""
WITH m AS (
  SELECT DISTINCT group_id, unnest(list_append(coalesce(member_chunk_ids, []), canonical_chunk_id)) AS chunk_id FROM dedup_groups),
u AS (
  SELECT chunk_id, length(trim(text, E' \t\r\n')) AS n,
    CASE WHEN resolved_timestamp = TIMESTAMP '1970-01-01' OR resolved_timestamp > last_seen_by_pulse THEN NULL ELSE resolved_timestamp END AS ts
  FROM chunks WHERE deleted_at IS NULL AND text IS NOT NULL AND length(trim(text, E' \t\r\n')) > 0),
j AS (SELECT group_id, chunk_id, n, ts FROM m JOIN u USING (chunk_id)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ts DESC NULLS LAST, n DESC, chunk_id) AS rt,
    row_number() OVER (PARTITION BY group_id ORDER BY n DESC, ts DESC NULLS LAST, chunk_id) AS rx FROM j)
SELECT a.group_id, a.chunk_id AS ts_chunk_id, b.chunk_id AS text_chunk_id
FROM r a JOIN r b USING (group_id) WHERE a.rt = 1 AND a.ts IS NOT NULL AND b.rx = 1
"""
_P6S = _P6.split("j AS")[0].replace("SELECT chunk_id, length", "SELECT chunk_id, store_id, collection, text, timestamp_source, content_hash, staleness_label, length")
_PICK = """CASE WHEN bool_or({0} IS NOT NULL) THEN arg_min({0}, {1}) FILTER ({0} IS NOT NULL) END AS {0}, arg_min(chunk_id, {1}) FILTER ({0} IS NOT NULL) AS {0}_chunk_id"""
_ATTRIBUTES = ["store_id", "collection", "text", "resolved_timestamp", "timestamp_source", "content_hash", "staleness_label"]
SQL = {
    "p6_survivors": _P6S + """j AS (SELECT group_id, chunk_id, n, ts AS resolved_timestamp, store_id, collection, text, timestamp_source, content_hash, staleness_label,
          -CASE timestamp_source WHEN 'metadata_field' THEN 4 WHEN 'uuid_v1' THEN 3 WHEN 'ulid' THEN 2 WHEN 'first_seen' THEN 1 ELSE 0 END AS k,
          coalesce(-epoch_us(ts), 4611686018427387904) AS late FROM m JOIN u USING (chunk_id))
        SELECT group_id, count(*) AS n_members, """ + ", ".join(_PICK.format(a, "(-n, k, late, chunk_id)" if a == "text" else "(k, late, chunk_id)") for a in _ATTRIBUTES) + " FROM j GROUP BY 1",
    "p6_found": _P6,
    "p7_found": _P7 + "SELECT group_key, chunk_id FROM found",
    "p7_sizes": _P7 + "SELECT group_key, count(*) AS n_members FROM found GROUP BY group_key",
}
