"""Ingest: snapshot diff, statistics, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.ingest import apply_diff, latest_records, snapshot_diff
from corpuslens.operators.instants import CROCKFORD, id_instant
from corpuslens.sources.tables import load

NOW = "2026-07-01 00:00:00"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return latest_records(load(spark, d, "chunk_records").select("record_no", "collection", "chunk_id", "text"), load(spark, d, "collection_settings")), load(spark, d, "chunks")


def ingest_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Status and next version of every chunk of the feed and of the control table."""
    return snapshot_diff(*_sides(spark, d))


def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by status."""
    return ingest_snapshot_diff(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def ingest_apply(spark: SparkSession, d: str) -> DataFrame:
    """The control table after the diff, summed up by collection."""
    inc, old = _sides(spark, d)
    n = apply_diff(snapshot_diff(inc, old), inc, old, NOW)
    return n.groupBy("collection").agg(
        F.count("*").alias("n"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.sum("version").alias("versions"),
        F.count_if(F.col("last_seen_by_pulse") == F.lit(NOW).cast("timestamp_ntz")).alias("n_seen"))


def content_hash_check(spark: SparkSession, d: str) -> DataFrame:
    """Stored hashes against the texts by collection."""
    c = load(spark, d, "chunks")
    ok = F.lower("content_hash") == F.sha2(F.col("text").cast("binary"), 256)
    return c.groupBy("collection").agg(F.count_if(ok).alias("n_right"), F.count_if(~ok).alias("n_wrong"), F.count_if(ok.isNull()).alias("n_unknown"))


def id_instants(spark: SparkSession, d: str) -> DataFrame:
    """Time inside version-1 UUIDs and ULIDs."""
    c = load(spark, d, "chunks").select("chunk_id", id_instant(F.col("chunk_id")).alias("utc_us"))
    return c.filter("utc_us is not null")


_SIDES = """f AS (
  SELECT s.store_id, r.collection, r.chunk_id, r.text FROM (
    SELECT * FROM chunk_records QUALIFY row_number() OVER (PARTITION BY collection, chunk_id ORDER BY record_no DESC) = 1) r
  JOIN (SELECT collection, max(store_id) AS store_id FROM collection_settings GROUP BY 1) s USING (collection)),
del AS (SELECT DISTINCT store_id, collection FROM f),
x AS (
  SELECT coalesce(f.store_id, o.store_id) AS store_id, coalesce(f.collection, o.collection) AS collection, coalesce(f.chunk_id, o.chunk_id) AS chunk_id,
    CASE WHEN o.chunk_id IS NULL THEN 'new'
      WHEN f.chunk_id IS NULL THEN CASE WHEN o.deleted_at IS NULL AND EXISTS (SELECT 1 FROM del WHERE del.store_id = o.store_id AND del.collection = o.collection) THEN 'deleted' ELSE 'absent' END
      WHEN md5(coalesce(f.text, '')) = md5(coalesce(o.text, '')) THEN 'unchanged' ELSE 'updated' END AS status, o.version, o.deleted_at
  FROM f FULL JOIN chunks o ON f.store_id = o.store_id AND f.collection = o.collection AND f.chunk_id = o.chunk_id),
y AS (SELECT *, CAST(CASE status WHEN 'new' THEN 1 WHEN 'updated' THEN coalesce(version, 1) + 1 ELSE version END AS INT) AS next_version FROM x)"""
QUERIES = {f.__name__: f for f in (ingest_snapshot_diff, ingest_stats, ingest_apply, content_hash_check, id_instants)}
SQL = {
    "ingest_snapshot_diff": f"WITH {_SIDES} SELECT store_id, collection, chunk_id, status, next_version FROM y",
    "ingest_stats": f"WITH {_SIDES} SELECT status, count(*) AS n FROM y GROUP BY 1",
    "ingest_apply": f"""WITH {_SIDES} SELECT collection, count(*) AS n,
        count(CASE WHEN status = 'deleted' OR (status IN ('unchanged', 'absent') AND deleted_at IS NOT NULL) THEN 1 END) AS n_deleted,
        CAST(sum(next_version) AS BIGINT) AS versions, count(CASE WHEN status IN ('new', 'updated', 'unchanged') THEN 1 END) AS n_seen FROM y GROUP BY 1""",
    "content_hash_check": """SELECT collection, count(*) FILTER (lower(content_hash) = sha256(text)) AS n_right,
        count(*) FILTER (lower(content_hash) <> sha256(text)) AS n_wrong, count(*) FILTER (content_hash IS NULL OR text IS NULL) AS n_unknown FROM chunks GROUP BY 1""",
    "id_instants": f"""WITH c AS (SELECT chunk_id, lower(chunk_id) AS l, upper(chunk_id) AS u FROM chunks)
        SELECT chunk_id, CASE WHEN regexp_full_match(l, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-1[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}')
          THEN (CAST('0x' || substr(l, 16, 3) || substr(l, 10, 4) || substr(l, 1, 8) AS BIGINT) - 122192928000000000) // 10
          ELSE CAST(list_sum(list_transform(range(1, 11), lambda i: (instr('{CROCKFORD}', substr(u, CAST(i AS INT), 1)) - 1) * pow(32, 10 - i))) AS BIGINT) * 1000 END AS utc_us
        FROM c WHERE regexp_full_match(l, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-1[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}')
          OR (regexp_full_match(u, '[{CROCKFORD}]{{26}}') AND list_sum(list_transform(range(1, 11), lambda i: (instr('{CROCKFORD}', substr(u, CAST(i AS INT), 1)) - 1) * pow(32, 10 - i))) <= 253402300799999)""",
}
