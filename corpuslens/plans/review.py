"""Review and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import preview
from corpuslens.operators import contradictions as C
from corpuslens.plans.catalog import CONTRADICTIONS
from corpuslens.sources.tables import contradictions, load

RUN, NOW = "run-202506", "2026-07-01 00:00:00"


def contradictions_view(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 50 unresolved pairs, highest score first, both sides' collections joined."""
    v = C.review_view(contradictions(spark, d), load(spark, d, "chunks"), state="unresolved")
    return v.filter("max_score is not null").orderBy(F.desc("max_score"), "a", "b").offset(50).limit(50).select(
        "a", "b", "detectors", F.round("max_score", 4).alias("max_score"), "collection_a", "collection_b", F.length("preview_a").alias("n_preview_a"))


def contradictions_all(spark: SparkSession, d: str) -> DataFrame:
    """Signals of every pair."""
    v = C.review_view(contradictions(spark, d), load(spark, d, "chunks"))
    return v.select("a", "b", "detectors", "nli_score", "numeric_score", "version_score", "user_resolution", "last_run", "collection_a", "collection_b")


def contradictions_detector_having(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that the version detector found, with the signals of the others."""
    v = C.review_view(contradictions(spark, d), load(spark, d, "chunks"), detector="version")
    return v.select("a", "b", "detectors", "nli_score", "version_score", F.col("version_score").isNotNull().alias("has_version"))


def contradictions_count(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs by run and state."""
    c = C.pair_key(contradictions(spark, d).filter("chunk_a is not null and chunk_b is not null"))
    state = F.when(F.col("user_resolution").isNull(), "unresolved").otherwise("resolved")
    return c.select("scan_run_id", state.alias("state"), "a", "b").distinct().groupBy("scan_run_id", "state").agg(F.count("*").alias("n"))


def resolution_summary(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs by verdict; a pair with two verdicts counts in both."""
    c = C.pair_key(contradictions(spark, d).filter("chunk_a is not null and chunk_b is not null"))
    s = F.coalesce("user_resolution", F.lit("unresolved"))
    return c.select(s.alias("resolution"), "a", "b").distinct().groupBy("resolution").agg(F.count("*").alias("n"))


def resolve_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Rows by verdict after the pairs of the high scores are confirmed, in either order."""
    c = contradictions(spark, d)
    v = c.filter("raw_score >= 0.95 and chunk_a is not null and chunk_b is not null").select(
        F.col("chunk_b").alias("chunk_a"), F.col("chunk_a").alias("chunk_b"), F.lit("confirmed").alias("resolution")).distinct()
    r = C.resolve(c, v, NOW)
    return r.groupBy("detector", "user_resolution").agg(F.count("*").alias("n"), F.count("resolved_at").alias("n_resolved"))


def dedup_groups_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Members of each group in their order with what is known of them."""
    g = load(spark, d, "dedup_groups").distinct().select("group_id", "canonical_chunk_id", F.posexplode("member_chunk_ids").alias("pos", "chunk_id"))
    c = load(spark, d, "chunks").select("chunk_id", "collection", "resolved_timestamp", F.length(preview("text", 200)).alias("n_preview"))
    return g.join(c, "chunk_id", "left").select(
        "group_id", "pos", "chunk_id", "collection", F.date_format("resolved_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "n_preview",
        (F.col("chunk_id") == F.col("canonical_chunk_id")).alias("is_canonical"))


def dedup_channels(spark: SparkSession, d: str) -> DataFrame:
    """Groups and members by detection channels."""
    g = load(spark, d, "dedup_groups").withColumn("channels", F.array_join(F.array_sort(F.array_distinct("detection_channels")), ","))
    return g.groupBy("channels").agg(F.count("*").alias("n_groups"), F.sum(F.size(F.array_distinct("member_chunk_ids"))).alias("n_members"))


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """The report's summary in one row."""
    g = load(spark, d, "dedup_groups").agg(F.count("*").alias("dedup_groups"), F.sum(F.size("member_chunk_ids")).alias("chunks_in_dedup_groups"))
    c = contradictions(spark, d).filter(F.col("user_resolution").isNull() & (F.col("scan_run_id") == RUN)).agg(F.count("*").alias("contradictions_unresolved"))
    s = load(spark, d, "chunks").filter("deleted_at is null").agg(
        *[F.count_if(F.col("staleness_label") == x).alias(x) for x in ("fresh", "aging", "stale", "abandoned")])
    one = lambda x: x.withColumn("_1", F.lit(1))
    return one(g).join(one(c), "_1").join(one(s), "_1").drop("_1")


def report_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Contradictions of one run with both sides' collections."""
    c = contradictions(spark, d).filter(F.col("scan_run_id") == RUN)
    t = load(spark, d, "chunks").select("chunk_id", "collection")
    for s in "ab":
        c = c.join(t.select(F.col("chunk_id").alias(f"chunk_{s}"), F.col("collection").alias(f"collection_{s}")), f"chunk_{s}", "left")
    return c.select("chunk_a", "chunk_b", "detector", "raw_score", "user_resolution", "collection_a", "collection_b").orderBy("chunk_a", "chunk_b")


def report_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Scored chunks with their components and whether a group supersedes them."""
    sup = load(spark, d, "dedup_groups").select("canonical_chunk_id", F.explode("member_chunk_ids").alias("chunk_id")).filter(
        "chunk_id != canonical_chunk_id").select("chunk_id").distinct().withColumn("is_superseded", F.lit(True))
    c = load(spark, d, "chunks").filter("deleted_at is null and staleness_score is not null")
    return c.join(sup, "chunk_id", "left").select(
        "chunk_id", F.round("staleness_score", 4).alias("staleness_score"), "staleness_label", F.col("staleness_components.age_decay").alias("age_decay"),
        F.coalesce("is_superseded", F.lit(False)).alias("is_superseded"))


def report_collections(spark: SparkSession, d: str) -> DataFrame:
    """Active chunks by store type and collection."""
    c = load(spark, d, "chunks").filter("deleted_at is null")
    return c.groupBy(F.split("store_id", ":")[0].alias("store_type"), "collection").agg(F.count("*").alias("n"))


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 25 groups, 50 chunks and 25 pairs."""
    n = lambda name, df, size: df.agg(F.count("*").alias("total")).select(F.lit(name).alias("list"), "total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int").alias("pages"))
    return n("groups", load(spark, d, "dedup_groups"), 25).unionByName(
        n("staleness", load(spark, d, "chunks").filter("deleted_at is null and staleness_score is not null"), 50)).unionByName(
        n("pairs", C.pair_key(contradictions(spark, d)).filter("a is not null and b is not null and chunk_a is not null and chunk_b is not null").select("a", "b").distinct(), 25))


QUERIES = {f.__name__: f for f in (
    contradictions_view, contradictions_all, contradictions_detector_having, contradictions_count, resolution_summary, resolve_verdict,
    dedup_groups_enriched, dedup_channels, report_summary, report_contradictions, report_staleness, report_collections, page_numbers)}
_PAIR = "k AS (SELECT *, least(chunk_a, chunk_b) AS a, greatest(chunk_a, chunk_b) AS b FROM c WHERE chunk_a IS NOT NULL AND chunk_b IS NOT NULL)"


def _view(where: str = "true") -> str:
    return f"""{CONTRADICTIONS}, {_PAIR}, v AS (SELECT a, b, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors,
      max(CASE WHEN detector = 'nli' THEN raw_score END) AS nli_score, max(CASE WHEN detector = 'numeric' THEN raw_score END) AS numeric_score,
      max(CASE WHEN detector = 'version' THEN raw_score END) AS version_score, max(raw_score) AS max_score, max(user_resolution) AS user_resolution,
      max(scan_run_id) AS last_run, sum(CAST(detector = 'version' AS INT)) AS nv FROM k WHERE {where} GROUP BY a, b),
    w AS (SELECT v.*, x.collection AS collection_a, y.collection AS collection_b, length(substr(x.text, 1, 300)) AS n_preview_a, x.chunk_id AS xa, x.text AS xt
      FROM v LEFT JOIN chunks x ON x.chunk_id = a LEFT JOIN chunks y ON y.chunk_id = b)"""


SQL = {
    "contradictions_view": f"""WITH {_view("user_resolution IS NULL")} SELECT a, b, detectors, round(max_score, 4) AS max_score, collection_a, collection_b,
        CAST(CASE WHEN xa IS NULL THEN NULL ELSE length(substr(coalesce(xt, ''), 1, 300)) END AS INT) AS n_preview_a
        FROM w WHERE max_score IS NOT NULL ORDER BY w.max_score DESC, a, b LIMIT 50 OFFSET 50""",
    "contradictions_all": f"WITH {_view()} SELECT a, b, detectors, nli_score, numeric_score, version_score, user_resolution, last_run, collection_a, collection_b FROM w",
    "contradictions_detector_having": f"WITH {_view()} SELECT a, b, detectors, nli_score, version_score, version_score IS NOT NULL AS has_version FROM w WHERE nv > 0",
    "contradictions_count": f"""WITH {CONTRADICTIONS}, {_PAIR} SELECT scan_run_id, state, count(*) AS n FROM (
        SELECT DISTINCT scan_run_id, CASE WHEN user_resolution IS NULL THEN 'unresolved' ELSE 'resolved' END AS state, a, b FROM k) GROUP BY 1, 2""",
    "resolution_summary": f"WITH {CONTRADICTIONS}, {_PAIR} SELECT resolution, count(*) AS n FROM (SELECT DISTINCT coalesce(user_resolution, 'unresolved') AS resolution, a, b FROM k) GROUP BY 1",
    "resolve_verdict": f"""WITH {CONTRADICTIONS}, {_PAIR}, h AS (SELECT DISTINCT a, b FROM k WHERE raw_score >= 0.95),
        z AS (SELECT c.*, h.a IS NOT NULL AS hit FROM c LEFT JOIN h ON h.a = least(c.chunk_a, c.chunk_b) AND h.b = greatest(c.chunk_a, c.chunk_b) AND c.chunk_a IS NOT NULL AND c.chunk_b IS NOT NULL)
        SELECT detector, CASE WHEN hit THEN 'confirmed' ELSE user_resolution END AS user_resolution, count(*) AS n, count(*) FILTER (hit) AS n_resolved FROM z GROUP BY 1, 2""",
    "dedup_groups_enriched": """WITH g AS (SELECT DISTINCT group_id, canonical_chunk_id, member_chunk_ids, detection_channels FROM dedup_groups),
        m AS (SELECT group_id, canonical_chunk_id, unnest(member_chunk_ids) AS chunk_id, CAST(unnest(range(0, len(member_chunk_ids))) AS INT) AS pos FROM g)
        SELECT group_id, pos, m.chunk_id, collection, strftime(resolved_timestamp, '%Y-%m-%dT%H:%M:%S') AS "timestamp",
          CAST(CASE WHEN c.chunk_id IS NULL THEN NULL ELSE length(substr(coalesce(text, ''), 1, 200)) END AS INT) AS n_preview, m.chunk_id = canonical_chunk_id AS is_canonical
        FROM m LEFT JOIN chunks c ON c.chunk_id = m.chunk_id""",
    "dedup_channels": """SELECT array_to_string(list_sort(list_distinct(detection_channels)), ',') AS channels, count(*) AS n_groups,
        CAST(sum(len(list_distinct(member_chunk_ids))) AS BIGINT) AS n_members FROM dedup_groups GROUP BY 1""",
    "report_summary": f"""WITH {CONTRADICTIONS} SELECT (SELECT count(*) FROM dedup_groups) AS dedup_groups, (SELECT CAST(sum(len(member_chunk_ids)) AS BIGINT) FROM dedup_groups) AS chunks_in_dedup_groups,
        (SELECT count(*) FROM c WHERE user_resolution IS NULL AND scan_run_id = '{RUN}') AS contradictions_unresolved,
        count(*) FILTER (staleness_label = 'fresh') AS fresh, count(*) FILTER (staleness_label = 'aging') AS aging, count(*) FILTER (staleness_label = 'stale') AS stale,
        count(*) FILTER (staleness_label = 'abandoned') AS abandoned FROM chunks WHERE deleted_at IS NULL""",
    "report_contradictions": f"""WITH {CONTRADICTIONS} SELECT chunk_a, chunk_b, detector, raw_score, user_resolution, x.collection AS collection_a, y.collection AS collection_b
        FROM c LEFT JOIN chunks x ON x.chunk_id = chunk_a LEFT JOIN chunks y ON y.chunk_id = chunk_b WHERE scan_run_id = '{RUN}'""",
    "report_staleness": """WITH s AS (SELECT DISTINCT id FROM (SELECT canonical_chunk_id, unnest(member_chunk_ids) AS id FROM dedup_groups) WHERE id <> canonical_chunk_id)
        SELECT chunk_id, round(staleness_score, 4) AS staleness_score, staleness_label, staleness_components.age_decay AS age_decay, s.id IS NOT NULL AS is_superseded
        FROM chunks LEFT JOIN s ON s.id = chunk_id WHERE deleted_at IS NULL AND staleness_score IS NOT NULL""",
    "report_collections": "SELECT split_part(store_id, ':', 1) AS store_type, collection, count(*) AS n FROM chunks WHERE deleted_at IS NULL GROUP BY 1, 2",
    "page_numbers": f"""WITH {CONTRADICTIONS}, {_PAIR}, t AS (SELECT 'groups' AS list, count(*) AS total, 25 AS s FROM dedup_groups
        UNION ALL SELECT 'staleness', count(*), 50 FROM chunks WHERE deleted_at IS NULL AND staleness_score IS NOT NULL
        UNION ALL SELECT 'pairs', count(*), 25 FROM (SELECT DISTINCT a, b FROM k))
        SELECT list, total, CAST(greatest(1, ceil(total / s)) AS INT) AS pages FROM t""",
}
