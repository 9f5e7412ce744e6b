"""Catalogue, counts and overview queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.scores import LABELS
from corpuslens.operators.contradictions import pair_key
from corpuslens.operators.ingest import since
from corpuslens.sources.tables import contradictions, load

PREFIX, SINCE = "billing_", "2025-01-01 00:00:00"


def collections_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Collections with their chunk counts."""
    return load(spark, d, "chunk_records").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n"))


def prefix_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Collections under a prefix, the prefix stripped."""
    c = load(spark, d, "chunk_records").filter(F.col("collection").startswith(PREFIX))
    return c.groupBy(F.substring("collection", len(PREFIX) + 1, 1000).alias("name")).agg(F.count("*").alias("n"))


def since_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows received since a moment; rows without time are kept."""
    r = load(spark, d, "chunk_records").select("record_no", "received_at")
    return since(r, F.col("received_at").cast("timestamp"), SINCE).select("record_no")


def get_embeddings_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of requested ids (every 50th, descending) in the order of the request."""
    e = load(spark, d, "embeddings")
    ask = e.filter("vec_id % 50 = 0").agg(F.sort_array(F.collect_list("vec_id"), asc=False).alias("ids"))
    ask = ask.select(F.posexplode("ids").alias("pos", "vec_id"))
    return ask.join(e, "vec_id").select("pos", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


def chunks_active_by_collection(spark: SparkSession, d: str) -> DataFrame:
    """Total, active and deleted chunks by collection."""
    c = load(spark, d, "chunks")
    return c.groupBy("collection").agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("active"),
                                       F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


def with_embedding_by_store(spark: SparkSession, d: str) -> DataFrame:
    """Active chunks with a vector, and clustered ones, by store."""
    c = load(spark, d, "chunks").filter("deleted_at is null and embedding_offset >= 0")
    return c.groupBy("store_id").agg(F.count("*").alias("n"), F.count("cluster_id").alias("n_clustered"))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the feed holds more than once."""
    return load(spark, d, "chunk_records").groupBy("collection", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1")


def available_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs, newest first."""
    return load(spark, d, "scan_runs").select("run_id", "started_at").orderBy(F.desc_nulls_last("started_at"), "run_id")


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    """JSON statistics of the runs as columns."""
    r = load(spark, d, "scan_runs")
    s = F.from_json("stats", "new long, updated long, deleted long, budget_hit boolean")
    secs = F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return r.select("run_id", s.alias("s"), secs.alias("elapsed_secs")).select("run_id", "s.new", "s.updated", "s.deleted", "elapsed_secs")


def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    """The head line of the review screen in one row."""
    c = load(spark, d, "chunks")
    a = c.agg(F.count("*").alias("total_chunks"), F.count_if(F.col("deleted_at").isNull()).alias("active_chunks"),
              F.count_if(F.col("deleted_at").isNull() & (F.col("staleness_label") == "fresh")).alias("fresh_chunks"))
    g = load(spark, d, "dedup_groups").agg(F.count("*").alias("dedup_groups"))
    o = pair_key(contradictions(spark, d)).filter("user_resolution is null and chunk_a is not null and chunk_b is not null").select("a", "b").distinct().agg(
        F.count("*").alias("open_contradictions"))
    k = c.filter("deleted_at is null").agg(F.count_distinct("collection").alias("collections"))
    pct = F.round(F.col("fresh_chunks") * 100 / F.greatest("active_chunks", F.lit(1))).cast("int")
    # One row each: a join of scalars.
    j = a.withColumn("_1", F.lit(1)).join(g.withColumn("_1", F.lit(1)), "_1").join(o.withColumn("_1", F.lit(1)), "_1").join(k.withColumn("_1", F.lit(1)), "_1")
    return j.withColumn("percent_fresh", pct).drop("_1")


def staleness_label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Active chunks by label, all four labels present."""
    dim = spark.createDataFrame([(x,) for x in LABELS], "staleness_label string")
    n = load(spark, d, "chunks").filter("deleted_at is null and staleness_label is not null").groupBy("staleness_label").agg(F.count("*").alias("n"))
    return dim.join(n, "staleness_label", "left").fillna(0, ["n"])


def latest_per_collection(spark: SparkSession, d: str) -> DataFrame:
    """Newest row of each collection by (time, id)."""
    c = load(spark, d, "chunks").filter("resolved_timestamp is not null")
    return c.groupBy("collection").agg(F.max(F.struct("resolved_timestamp", "chunk_id")).alias("m")).select(
        "collection", F.col("m.chunk_id").alias("chunk_id"), F.col("m.resolved_timestamp").alias("resolved_timestamp"))


QUERIES = {f.__name__: f for f in (
    collections_catalog, prefix_catalog, since_filter, get_embeddings_ordered, chunks_active_by_collection, with_embedding_by_store,
    duplicate_keys, available_runs, run_stats, corpus_overview, staleness_label_counts, latest_per_collection)}
CONTRADICTIONS = """c AS (
  SELECT chunk_a, chunk_b, CASE channel WHEN 'exact' THEN 'nli' WHEN 'embedding' THEN 'numeric' ELSE 'version' END AS detector,
    score AS raw_score, CASE pair_no % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' END AS user_resolution, scan_run_id, pair_no
  FROM match_pairs)"""
SQL = {
    "collections_catalog": "SELECT collection AS name, count(*) AS n FROM chunk_records GROUP BY 1",
    "prefix_catalog": f"SELECT substr(collection, {len(PREFIX) + 1}) AS name, count(*) AS n FROM chunk_records WHERE starts_with(collection, '{PREFIX}') GROUP BY 1",
    "since_filter": f"SELECT record_no FROM chunk_records WHERE received_at IS NULL OR received_at >= TIMESTAMP '{SINCE}'",
    "get_embeddings_ordered": """SELECT CAST(row_number() OVER (ORDER BY vec_id DESC) - 1 AS INT) AS pos, vec_id, round(embedding[1]::DOUBLE, 6) AS first_value
        FROM embeddings WHERE vec_id % 50 = 0""",
    "chunks_active_by_collection": """SELECT collection, count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS active,
        count(deleted_at) AS deleted FROM chunks GROUP BY 1""",
    "with_embedding_by_store": """SELECT store_id, count(*) AS n, count(cluster_id) AS n_clustered FROM chunks
        WHERE deleted_at IS NULL AND embedding_offset >= 0 GROUP BY 1""",
    "duplicate_keys": "SELECT collection, chunk_id, count(*) AS n FROM chunk_records GROUP BY ALL HAVING count(*) > 1",
    "available_runs": "SELECT run_id, started_at FROM scan_runs",
    "run_stats": """SELECT run_id, CAST(json_extract(stats, '$.new') AS BIGINT) AS "new", CAST(json_extract(stats, '$.updated') AS BIGINT) AS updated,
        CAST(json_extract(stats, '$.deleted') AS BIGINT) AS deleted, CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS elapsed_secs FROM scan_runs""",
    "corpus_overview": f"""WITH {CONTRADICTIONS}, t AS (
        SELECT count(*) AS total_chunks, count(*) FILTER (deleted_at IS NULL) AS active_chunks,
          count(*) FILTER (deleted_at IS NULL AND staleness_label = 'fresh') AS fresh_chunks,
          count(DISTINCT CASE WHEN deleted_at IS NULL THEN collection END) AS collections FROM chunks)
        SELECT t.*, (SELECT count(*) FROM dedup_groups) AS dedup_groups,
          (SELECT count(*) FROM (SELECT DISTINCT least(chunk_a, chunk_b), greatest(chunk_a, chunk_b) FROM c
             WHERE user_resolution IS NULL AND chunk_a IS NOT NULL AND chunk_b IS NOT NULL)) AS open_contradictions,
          CAST(round(fresh_chunks * 100.0 / greatest(active_chunks, 1)) AS INT) AS percent_fresh FROM t""",
    "staleness_label_counts": """SELECT l AS staleness_label, count(chunk_id) AS n FROM (SELECT unnest(['fresh', 'aging', 'stale', 'abandoned']) AS l)
        LEFT JOIN chunks ON staleness_label = l AND deleted_at IS NULL GROUP BY 1""",
    "latest_per_collection": """SELECT collection, chunk_id, resolved_timestamp FROM chunks WHERE resolved_timestamp IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY collection ORDER BY resolved_timestamp DESC, chunk_id DESC) = 1""",
}
