"""Vector queries: norms, neighbours, calibration, embedding dedup, clusters, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import scores, vectors
from corpuslens.operators import neighbourhood as N
from corpuslens.operators.grids import nearest_pairs
from corpuslens.operators.groups import dense_ids, group_table
from corpuslens.session import Stage
from corpuslens.sources.tables import load

DIM, DEDUP, DENSITY = 64, 0.9, 0.85


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Active chunks with their (first delivered) good vector, cluster and collection."""
    v = load(spark, d, "chunk_records").select("chunk_id", "record_no", "embedding").filter(vectors.is_good(F.col("embedding"), DIM))
    v = v.groupBy("chunk_id").agg(F.min_by("embedding", "record_no").alias("embedding"))
    c = load(spark, d, "chunks").filter("deleted_at is null").select("chunk_id", "cluster_id", "collection", "text", "resolved_timestamp")
    return c.join(v, "chunk_id")


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return chunk_vectors(spark, d).filter("cluster_id is not null")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norm of each vector."""
    return load(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


def vector_quality(spark: SparkSession, d: str) -> DataFrame:
    """Good and bad vectors of the feed by collection."""
    r = load(spark, d, "chunk_records").select("collection", vectors.is_good(F.col("embedding"), DIM).alias("ok"))
    return r.groupBy("collection").agg(F.count_if("ok").alias("n_good"), F.count_if(~F.col("ok")).alias("n_bad"))


def knn10(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 50, against all."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return N.blocked_knn(e.filter("id % 50 = 0"), e, 10).select(F.col("q").alias("vec_id"), F.col("b").alias("neighbour_id"), F.round("cosine", 5).alias("cosine"), "rank")


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return N.calibration_sample(load(spark, d, "embeddings"), "vec_id", "embedding")


def calibration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of baseline and neighbour cosines."""
    p = N.percentiles(_sample(spark, d))
    return p.select("kind", "n", *[F.round(x, 5).alias(x) for x in ("p50", "p95", "p99")])


def calibration_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds from the percentiles."""
    t = N.threshold_row(_sample(spark, d), DIM)
    return t.select(*[F.round(c, 5).alias(c) for c in t.columns])


def model_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Default thresholds of the nearest known dimension of each vector length in the feed."""
    dim = spark.createDataFrame([(k, *v) for k, v in scores.MODEL_DEFAULTS.items()], "dim int, dedup double, contradiction double, density double")
    n = load(spark, d, "chunk_records").filter("embedding is not null").groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    j = n.withColumn("_1", F.lit(1)).join(F.broadcast(dim.withColumn("_1", F.lit(1))), "_1")  # five rows of constants
    m = F.min(F.struct(F.abs(F.col("dim") - F.col("length")).alias("x"), "dim", "dedup", "contradiction", "density"))
    return j.groupBy("length", "n").agg(m.alias("m")).select("length", "n", "m.dim", "m.dedup", "m.contradiction", "m.density")


def growth_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Whether a corpus that grew from its stored snapshot to its feed is calibrated or refitted anew."""
    old = load(spark, d, "chunks").filter("first_seen_by_pulse < timestamp'2025-01-01'").agg(F.count("*").alias("before"))
    now = load(spark, d, "chunks").agg(F.count("*").alias("now"))
    g = (F.col("now") - F.col("before")) / F.greatest("before", F.lit(1))
    return old.withColumn("_1", F.lit(1)).join(now.withColumn("_1", F.lit(1)), "_1").select(
        "before", "now", (g > 0.5).alias("recalibrate"), (g > 0.2).alias("refit"), scores.auto_min_cluster_size(F.col("now")).alias("min_cluster_size"))


def cluster_pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five most similar members of its cluster for each chunk."""
    p = N.cluster_cosines(clustered(spark, d), top=5)
    return p.select("cluster_id", "a", "b", F.round("cosine", 6).alias("cosine"))


def near_pairs(spark: SparkSession, d: str, k: int, least: float) -> DataFrame:
    """The k most similar others of every active chunk with a vector, over the whole collection."""
    v = chunk_vectors(spark, d).select("chunk_id", "embedding")
    v = Stage(spark, "active-vectors").put(v, "vectors")
    return nearest_pairs(v, "chunk_id", "embedding", k, least, DIM)


def dedup_embedding_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs among the ten nearest of any active chunk with a cosine over the threshold."""
    p = near_pairs(spark, d, 10, DEDUP)
    return p.groupBy(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")).agg(F.round(F.max("cosine"), 6).alias("cosine"))


def dedup_embedding_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of those edges with canonical chunk and dense ids."""
    e = dedup_embedding_edges(spark, d).select(F.col("chunk_a").alias("a"), F.col("chunk_b").alias("b"))
    return dense_ids(group_table(e, load(spark, d, "chunks"))).select("group_id", "canonical_chunk_id", "n_members")


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Active members of each cluster, and the share of the largest."""
    c = load(spark, d, "chunks").filter("deleted_at is null and cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("m")).withColumn("_1", F.lit(1))
    return c.withColumn("_1", F.lit(1)).join(F.broadcast(top), "_1").select("cluster_id", "n", F.round(F.col("n") / F.col("m"), 6).alias("share_of_largest"))  # one row


def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Size and a digest of each cluster's centroid."""
    c = N.centroids(clustered(spark, d).select("cluster_id", "embedding"))
    return c.select("cluster_id", "n_chunks", F.round(F.col("centroid")[0], 6).alias("first_value"), F.round(vectors.norm(F.col("centroid")), 5).alias("norm"))


def cluster_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of each chunk from its cluster's centroid; 0 without cluster."""
    v = chunk_vectors(spark, d).select("chunk_id", "cluster_id", "embedding")
    c = N.centroids(v.filter("cluster_id is not null").select("cluster_id", "embedding"))
    return v.join(c, "cluster_id", "left").select("chunk_id", F.round(N.drift(F.col("embedding"), F.col("centroid")), 5).alias("drift"))


def _density(spark: SparkSession, d: str, min_size: int = 5) -> DataFrame:
    return N.density_clusters(near_pairs(spark, d, 10, DENSITY), min_size=min_size)


def cluster_graph(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of mutual neighbours among all active chunks with a vector."""
    return _density(spark, d)


def cluster_assigned(spark: SparkSession, d: str) -> DataFrame:
    """New cluster ids of all active chunks with a vector; null is noise."""
    got = N.assigned(_density(spark, d))
    return chunk_vectors(spark, d).select("chunk_id").join(got, "chunk_id", "left")


def hdbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchical density clusters inside each density cluster, by size."""
    rows = chunk_vectors(spark, d).join(_density(spark, d).select("chunk_id", F.col("cluster_key").alias("block")), "chunk_id")
    return N.block_hdbscan(rows).groupBy("block", "label").agg(F.count("*").alias("n"))


def auto_tune_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Minimum sizes around the automatic one (half, same, double) with their silhouettes; the best one is chosen."""
    v = Stage(spark, "tuned-vectors").put(chunk_vectors(spark, d).select("chunk_id", "embedding"), "vectors")
    base = max(5, int(v.count() ** 0.5 / 4))
    near = Stage(spark, "tuned").put(nearest_pairs(v, "chunk_id", "embedding", 10, DENSITY, DIM), "near")
    every = Stage(spark, "tuned-clusters").put(N.density_clusters(near, min_size=max(2, base // 2)), "clusters")
    out = None
    for m in sorted({max(2, base // 2), base, base * 2}):
        rows = v.join(every.filter(F.col("n") >= m).select("chunk_id", F.col("cluster_key").alias("cluster_id")), "chunk_id")
        s = N.silhouette(rows).withColumn("min_size", F.lit(m))
        out = s if out is None else out.unionByName(s)
    s = F.round(F.when(F.col("n_clusters") >= 2, F.col("silhouette")), 6)
    out = out.select("min_size", "n_clusters", "n_clustered", s.alias("silhouette")).withColumn("_1", F.lit(1))
    best = out.groupBy("_1").agg(F.max_by("min_size", F.struct(F.coalesce("silhouette", F.lit(-2.0)), -F.col("min_size"))).alias("m"))
    return out.join(F.broadcast(best), "_1").select("min_size", "n_clusters", "n_clustered", "silhouette", (F.col("min_size") == F.col("m")).alias("chosen"))  # one row


QUERIES = {f.__name__: f for f in (
    vector_norms, vector_quality, knn10, calibration_percentiles, calibration_thresholds, model_defaults, growth_triggers, cluster_pairs_topk,
    dedup_embedding_edges, dedup_embedding_groups, cluster_sizes, cluster_centroids, cluster_drift, cluster_graph, cluster_assigned, hdbscan_clusters, auto_tune_silhouette)}
_GOOD = "coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"
VEC = f"""v0 AS (SELECT chunk_id, arg_min(embedding, record_no)::DOUBLE[] AS e FROM chunk_records WHERE {_GOOD} GROUP BY 1),
v AS (SELECT c.chunk_id, cluster_id, collection, text, resolved_timestamp, e FROM chunks c JOIN v0 USING (chunk_id) WHERE deleted_at IS NULL)"""
CPAIRS = f"""vc AS (SELECT * FROM v WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY md5(chunk_id), chunk_id) <= {N.CLUSTER_CAP}),
cp AS (SELECT x.cluster_id, x.chunk_id AS a, y.chunk_id AS b, round(least(1, list_cosine_similarity(x.e, y.e)), 9) AS cosine
  FROM vc x JOIN vc y ON x.cluster_id = y.cluster_id AND x.chunk_id <> y.chunk_id)"""
_ALL = f"""{VEC}, ap AS (SELECT x.chunk_id AS a, y.chunk_id AS b, round(least(1, list_cosine_similarity(x.e, y.e)), 9) AS cosine FROM v x JOIN v y ON x.chunk_id <> y.chunk_id
  WHERE list_cosine_similarity(x.e, y.e) > {min(DEDUP, DENSITY) - 0.01}),
nn AS (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b DESC) <= 10)"""
_EDGES = f"{_ALL}, de AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(cosine) AS cosine FROM nn WHERE cosine > {DEDUP} GROUP BY 1, 2)"
_DENSE = f"""{_ALL}, mu AS (SELECT n.a, n.b FROM nn n JOIN nn k ON n.a = k.b AND n.b = k.a WHERE n.cosine > {DENSITY}), co AS (SELECT a FROM mu GROUP BY 1 HAVING count(*) >= 3),
ee AS (SELECT a, b FROM mu WHERE a IN (SELECT a FROM co) AND b IN (SELECT a FROM co)),
r(id, t) AS (SELECT a, b FROM ee UNION SELECT r.id, ee.b FROM r JOIN ee ON r.t = ee.a), lab AS (SELECT id, least(id, min(t)) AS label FROM r GROUP BY id),
dc AS (SELECT id AS chunk_id, label AS cluster_key, count(*) OVER (PARTITION BY label) AS n FROM lab)"""
_SAMPLE = """s0 AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 2000),
s AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM s0),
p AS (SELECT x.i AS a, y.i AS b, round(list_cosine_similarity(x.e, y.e), 9) AS cosine FROM s x JOIN s y ON x.vec_id <> y.vec_id),
q AS (SELECT 'baseline' AS kind, cosine FROM (SELECT * FROM p WHERE a < b ORDER BY ((a * 48271 + b * 16807) % 2147483647) * 69621 % 2147483647, a, b LIMIT 10000)
  UNION ALL SELECT 'neighbour', cosine FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC) <= 10)),
t AS (SELECT quantile_cont(cosine, 0.95) FILTER (kind = 'baseline') AS b95, quantile_cont(cosine, 0.5) FILTER (kind = 'neighbour') AS n50,
  quantile_cont(cosine, 0.99) FILTER (kind = 'neighbour') AS n99 FROM q)"""
_CENT = """u AS (SELECT cluster_id, unnest(range(0, 64)) AS pos, unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS x FROM v WHERE cluster_id IS NOT NULL),
m AS (SELECT cluster_id, pos, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL),
ce AS (SELECT cluster_id, max(n) AS n_chunks, list(x ORDER BY pos) AS c FROM m GROUP BY 1)"""
SQL = {
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings",
    "vector_quality": f"SELECT collection, count(*) FILTER ({_GOOD}) AS n_good, count(*) FILTER (NOT {_GOOD}) AS n_bad FROM chunk_records GROUP BY 1",
    "knn10": """SELECT x.vec_id, y.vec_id AS neighbour_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS cosine,
        CAST(row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) DESC, y.vec_id) AS INT) AS rank
        FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0 QUALIFY rank <= 10""",
    "calibration_percentiles": f"""WITH {_SAMPLE} SELECT kind, count(*) AS n, round(quantile_cont(cosine, 0.5), 5) AS p50, round(quantile_cont(cosine, 0.95), 5) AS p95,
        round(quantile_cont(cosine, 0.99), 5) AS p99 FROM q GROUP BY 1""",
    "calibration_thresholds": f"""WITH {_SAMPLE}, z AS (SELECT b95, n99 - 0.1 * (n99 - n50) AS dd, b95 + 0.5 * (n50 - b95) AS cc, n50 AS nn FROM t)
        SELECT round(CASE WHEN b95 < cc AND cc < dd AND dd < 1 THEN dd ELSE 0.95 END, 5) AS dedup_threshold,
          round(CASE WHEN b95 < cc AND cc < dd AND dd < 1 THEN cc ELSE 0.85 END, 5) AS contradiction_threshold,
          round(CASE WHEN b95 < cc AND cc < dd AND dd < 1 THEN nn ELSE 0.75 END, 5) AS cluster_min_density FROM z""",
    "model_defaults": """WITH d AS (SELECT * FROM (VALUES (384, 0.95, 0.85, 0.75), (768, 0.93, 0.82, 0.72), (1024, 0.92, 0.80, 0.70), (1536, 0.90, 0.78, 0.68), (3072, 0.88, 0.76, 0.65)) t(dim, dedup, contradiction, density)),
        n AS (SELECT CAST(len(embedding) AS INT) AS length, count(*) AS n FROM chunk_records WHERE embedding IS NOT NULL GROUP BY 1)
        SELECT length, n, dim, dedup::DOUBLE AS dedup, contradiction::DOUBLE AS contradiction, density::DOUBLE AS density FROM n, d
        QUALIFY row_number() OVER (PARTITION BY length ORDER BY abs(dim - length), dim) = 1""",
    "growth_triggers": """WITH t AS (SELECT count(*) FILTER (first_seen_by_pulse < TIMESTAMP '2025-01-01') AS before, count(*) AS now FROM chunks)
        SELECT before, now, (now - before) / greatest(before, 1) > 0.5 AS recalibrate, (now - before) / greatest(before, 1) > 0.2 AS refit,
          CAST(greatest(5, floor(sqrt(now) / 4)) AS INT) AS min_cluster_size FROM t""",
    "cluster_pairs_topk": f"WITH {VEC}, {CPAIRS} SELECT cluster_id, a, b, round(cosine, 6) AS cosine FROM cp QUALIFY row_number() OVER (PARTITION BY a ORDER BY cp.cosine DESC, b DESC) <= 5",
    "dedup_embedding_edges": f"WITH {_EDGES} SELECT a AS chunk_a, b AS chunk_b, round(cosine, 6) AS cosine FROM de",
    "dedup_embedding_groups": f"""WITH RECURSIVE {_EDGES}, ee AS (SELECT a, b FROM de UNION SELECT b, a FROM de),
        r(id, t) AS (SELECT a, b FROM ee UNION SELECT r.id, ee.b FROM r JOIN ee ON r.t = ee.a), lab AS (SELECT id, least(id, min(t)) AS label FROM r GROUP BY id),
        m AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY resolved_timestamp DESC NULLS LAST, length(coalesce(text, '')) DESC, id) AS k,
          count(*) OVER (PARTITION BY label) AS n_members FROM lab JOIN chunks ON chunk_id = id)
        SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS group_id, id AS canonical_chunk_id, n_members FROM m WHERE k = 1""",
    "cluster_sizes": """WITH c AS (SELECT cluster_id, count(*) AS n FROM chunks WHERE deleted_at IS NULL AND cluster_id IS NOT NULL GROUP BY 1)
        SELECT cluster_id, n, round(n / (SELECT max(n) FROM c), 6) AS share_of_largest FROM c""",
    "cluster_centroids": f"WITH {VEC}, {_CENT} SELECT cluster_id, n_chunks, round(c[1], 6) AS first_value, round(sqrt(list_dot_product(c, c)), 5) AS norm FROM ce",
    "cluster_drift": f"""WITH {VEC}, {_CENT} SELECT chunk_id, round(CASE WHEN c IS NULL THEN 0 ELSE 1 - list_cosine_similarity(e, c) END, 5) AS drift FROM v LEFT JOIN ce USING (cluster_id)""",
    "cluster_graph": f"WITH RECURSIVE {_DENSE} SELECT chunk_id, cluster_key, n FROM dc WHERE n >= 5",
    "cluster_assigned": f"""WITH RECURSIVE {_DENSE}, k AS (SELECT chunk_id, CAST(dense_rank() OVER (ORDER BY cluster_key) - 1 AS INT) AS cluster_id FROM dc WHERE n >= 5)
        SELECT chunk_id, k.cluster_id FROM v LEFT JOIN k USING (chunk_id)""",
    "auto_tune_silhouette": f"""WITH RECURSIVE {_DENSE}, ba AS (SELECT greatest(5, CAST(floor(sqrt(count(*)) / 4) AS INT)) AS base FROM v),
        sizes AS (SELECT DISTINCT unnest([greatest(2, base // 2), base, base * 2]) AS min_size FROM ba),
        w AS (SELECT min_size, chunk_id, cluster_key AS c, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM dc JOIN v USING (chunk_id) JOIN sizes ON n >= min_size),
        p AS (SELECT min_size, c, unnest(range(0, 64)) AS pos, unnest(u) AS x FROM w), m AS (SELECT min_size, c, pos, avg(x) AS x, count(*) AS n FROM p GROUP BY ALL),
        ce AS (SELECT min_size, c, any_value(n) AS n, list(x ORDER BY pos) AS m FROM m GROUP BY 1, 2),
        so AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY min_size ORDER BY md5(chunk_id), chunk_id) <= 2000),
        di AS (SELECT so.min_size, chunk_id, so.c = ce.c AS mine, n, 2 - 2 * list_dot_product(u, m) AS d FROM so JOIN ce ON so.min_size = ce.min_size),
        ab AS (SELECT min_size, chunk_id, max(d * n / (n - 1)) FILTER (mine AND n > 1) AS a, min(d) FILTER (NOT mine) AS b FROM di GROUP BY 1, 2),
        sc AS (SELECT min_size, avg(CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM ab WHERE b IS NOT NULL GROUP BY 1),
        q AS (SELECT sizes.min_size, count(ce.c) AS n_clusters, CAST(coalesce(sum(ce.n), 0) AS BIGINT) AS n_clustered FROM sizes LEFT JOIN ce ON ce.min_size = sizes.min_size GROUP BY 1),
        z AS (SELECT q.*, CASE WHEN n_clusters >= 2 THEN round(s, 6) END AS silhouette FROM q LEFT JOIN sc USING (min_size))
        SELECT min_size, n_clusters, n_clustered, silhouette, row_number() OVER (ORDER BY coalesce(silhouette, -2) DESC, min_size) = 1 AS chosen FROM z""",
}
