"""Triage, candidates, contradictions and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import scores
from corpuslens.operators import contradictions as C
from corpuslens.operators import neighbourhood as N
from corpuslens.operators.staleness import evidence_counts, scored
from corpuslens.operators.triage import allowed, priorities
from corpuslens.plans.catalog import CONTRADICTIONS
from corpuslens.plans.texts import SET
from corpuslens.plans.vectors import CPAIRS, VEC, chunk_vectors, clustered
from corpuslens.sources.tables import contradictions, load

NOW, BUDGET, K, CANDIDATE, HIT = "2026-07-01 00:00:00", 500, 5, 0.86, 0.3


def _priorities(spark: SparkSession, d: str) -> DataFrame:
    return priorities(load(spark, d, "chunks"), load(spark, d, "collection_settings"), NOW)


def triage_scored(spark: SparkSession, d: str) -> DataFrame:
    """Priority of every clustered active chunk."""
    return _priorities(spark, d)


def triage_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks within the budget, by priority."""
    return allowed(_priorities(spark, d), BUDGET, K)


def triage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scored and scanned chunks."""
    p = _priorities(spark, d).join(triage_allowed(spark, d).select("chunk_id").withColumn("was_scanned", F.lit(True)), "chunk_id", "left")
    return p.agg(F.count("*").alias("total"), F.sum(F.when(F.col("was_scanned"), 1).otherwise(0)).alias("scanned"))


def _candidates(spark: SparkSession, d: str, budgeted: bool = False) -> DataFrame:
    pairs = N.cluster_cosines(clustered(spark, d), top=K).select("a", "b", "cosine")
    return C.candidates(pairs, load(spark, d, "dedup_groups"), CANDIDATE, K, triage_allowed(spark, d) if budgeted else None)


def nli_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to be judged: top five of a cluster over the threshold, minus dedup pairs."""
    return _candidates(spark, d).select("chunk_a", "chunk_b", F.round("cosine", 6).alias("cosine"))


def nli_candidates_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """The same with queries restricted to the triage budget."""
    return _candidates(spark, d, True).select("chunk_a", "chunk_b", F.round("cosine", 6).alias("cosine"))


def nli_fused(spark: SparkSession, d: str) -> DataFrame:
    """Candidates judged by the lexical stand-in in both directions."""
    t = load(spark, d, "chunks").select("chunk_id", "text")
    p = _candidates(spark, d)
    for s in "ab":
        p = p.join(t.select(F.col("chunk_id").alias(f"chunk_{s}"), F.col("text").alias(f"text_{s}")), f"chunk_{s}")
    return C.fuse(C.lexical_scores(p), HIT).select("chunk_a", "chunk_b", "direction", F.round("raw_score", 6).alias("raw_score"))


def nli_retune_f05(spark: SparkSession, d: str) -> DataFrame:
    """Threshold with the best F0.5 on the judged pairs."""
    c = contradictions(spark, d).filter("user_resolution is not null and detector = 'nli'")
    return C.best_threshold(c.select(F.col("raw_score").alias("score"), (F.col("user_resolution") == "confirmed").alias("positive")))


def nli_backfill(spark: SparkSession, d: str) -> DataFrame:
    """States of the rows under the retuned threshold."""
    t = nli_retune_f05(spark, d).select("threshold").withColumn("_1", F.lit(1))
    c = contradictions(spark, d).filter("detector = 'nli' and raw_score is not null").withColumn("_1", F.lit(1))
    s = F.when(F.col("raw_score") >= F.col("threshold"), "calibrated").otherwise("below_threshold")
    return c.join(F.broadcast(t), "_1").groupBy(s.alias("calibration_state")).agg(F.count("*").alias("n"))  # one row


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence_counts(contradictions(spark, d))


def contradiction_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Open or confirmed contradictions of each chunk and their evidence."""
    return _evidence(spark, d).select("chunk_id", "n", F.round(scores.evidence(F.col("n")), 6).alias("evidence"))


def superseded_flags(spark: SparkSession, d: str) -> DataFrame:
    """Members that are not the canonical of their group."""
    g = load(spark, d, "dedup_groups").select("canonical_chunk_id", F.explode("member_chunk_ids").alias("chunk_id"))
    return g.filter("chunk_id != canonical_chunk_id").select("chunk_id").distinct()


def _half_life(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "collection_settings").groupBy("collection").agg(F.max("half_life_days").alias("half_life_days"))


def age_decay(spark: SparkSession, d: str) -> DataFrame:
    """Age component of every active chunk."""
    c = load(spark, d, "chunks").filter("deleted_at is null").select("chunk_id", "collection", "resolved_timestamp")
    hl = F.coalesce("half_life_days", F.lit(scores.HALF_LIFE))
    return c.join(_half_life(spark, d), "collection", "left").select(
        "chunk_id", F.round(scores.age_decay(F.col("resolved_timestamp"), F.lit(NOW).cast("timestamp"), hl), 6).alias("age_decay"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    v = chunk_vectors(spark, d).select("chunk_id", "cluster_id", "collection", "embedding", "resolved_timestamp")
    cen = N.centroids(v.filter("cluster_id is not null").select("cluster_id", "embedding"))
    r = scored(v, cen, _evidence(spark, d), superseded_flags(spark, d), _half_life(spark, d), F.lit(NOW).cast("timestamp"))
    return r.select("chunk_id", "collection", F.col("score").alias("s"))


def staleness_scored(spark: SparkSession, d: str) -> DataFrame:
    """Score and label of every active chunk with a vector."""
    return _scored(spark, d).select("chunk_id", F.round("s", 4).alias("staleness_score"), scores.staleness_label(F.col("s")).alias("staleness_label"))


def staleness_labels(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by collection and label."""
    return _scored(spark, d).groupBy("collection", scores.staleness_label(F.col("s")).alias("staleness_label")).agg(F.count("*").alias("n"))


def staleness_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of 25 stored scores of one label, highest first, with flat components."""
    c = load(spark, d, "chunks").filter("deleted_at is null and staleness_score is not null and staleness_label = 'stale'")
    return c.orderBy(F.desc("staleness_score"), "chunk_id").offset(50).limit(25).select(
        "chunk_id", F.round("staleness_score", 4).alias("staleness_score"), F.col("staleness_components.age_decay").alias("age_decay"),
        F.col("staleness_components.cluster_drift").alias("cluster_drift"))


QUERIES = {f.__name__: f for f in (
    triage_scored, triage_allowed, triage_summary, nli_candidates, nli_candidates_budgeted, nli_fused, nli_retune_f05, nli_backfill, contradiction_evidence,
    superseded_flags, age_decay, staleness_scored, staleness_labels, staleness_page)}
_HL = "hl AS (SELECT collection, max(half_life_days) AS h FROM collection_settings GROUP BY 1)"
_AGE = f"CASE WHEN resolved_timestamp IS NULL THEN 0 ELSE 1 - pow(2.0, -greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(resolved_timestamp)) / 86400e6) / coalesce(h, 90)) END"
_TRI = f"""{_HL}, tc AS (SELECT * FROM chunks WHERE deleted_at IS NULL AND cluster_id IS NOT NULL), sz AS (SELECT cluster_id, count(*) AS n FROM tc GROUP BY 1),
tp AS (SELECT chunk_id, round(0.5 * ({_AGE}) + 0.5 * n / (SELECT max(n) FROM sz), 6) AS priority FROM tc JOIN sz USING (cluster_id) LEFT JOIN hl USING (collection))"""
_ALLOW = f"al AS (SELECT chunk_id, priority FROM tp ORDER BY priority DESC, chunk_id LIMIT {BUDGET // K})"
_DUP = "gm AS (SELECT DISTINCT group_id, unnest(member_chunk_ids) AS id FROM dedup_groups), dp AS (SELECT DISTINCT x.id AS a, y.id AS b FROM gm x JOIN gm y USING (group_id))"


def _cand(where: str) -> str:
    return f"""{VEC}, {CPAIRS}, {_DUP}, tk AS (SELECT * FROM cp {where} QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b DESC) <= {K}),
    ca AS (SELECT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b, max(cosine) AS cosine FROM tk WHERE cosine > {CANDIDATE}
      AND NOT EXISTS (SELECT 1 FROM dp WHERE dp.a = tk.a AND dp.b = tk.b) GROUP BY 1, 2)"""


_BEST = f"""{CONTRADICTIONS}, l AS (SELECT raw_score AS s, sum(CAST(user_resolution = 'confirmed' AS INT)) AS p, count(*) AS n FROM c
  WHERE user_resolution IS NOT NULL AND detector = 'nli' AND raw_score IS NOT NULL GROUP BY 1),
g AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS al, sum(p) OVER () AS pos, sum(n) OVER () AS nl FROM l),
h AS (SELECT s, nl, tp / al AS pr, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS re FROM g),
k AS (SELECT s, nl, CASE WHEN 0.25 * pr + re > 0 THEN round(1.25 * pr * re / (0.25 * pr + re), 12) ELSE 0 END AS f FROM h),
bt AS (SELECT CASE WHEN count(*) > 0 AND max(nl) >= 5 AND max(f) > 0 THEN arg_min(s, (-f, s)) ELSE 0.5 END AS threshold,
  CASE WHEN max(nl) >= 5 AND max(f) > 0 THEN round(max(f), 6) ELSE 0.0 END AS f, CAST(coalesce(max(nl), 0) AS BIGINT) AS n_labels FROM k)"""
_EV = f"""{CONTRADICTIONS}, ev AS (SELECT chunk_id, count(*) AS n FROM (SELECT unnest([chunk_a, chunk_b]) AS chunk_id FROM c
  WHERE user_resolution IS NULL OR user_resolution = 'confirmed') WHERE chunk_id IS NOT NULL GROUP BY 1)"""
_SUP = "su AS (SELECT DISTINCT id AS chunk_id FROM (SELECT canonical_chunk_id, unnest(member_chunk_ids) AS id FROM dedup_groups) WHERE id <> canonical_chunk_id)"
_CENTROID = """u AS (SELECT cluster_id, unnest(range(0, 64)) AS pos, unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS x FROM v WHERE cluster_id IS NOT NULL),
m AS (SELECT cluster_id, pos, avg(x) AS x FROM u GROUP BY ALL), ce AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM m GROUP BY 1)"""
_STALE = f"""{VEC}, {_CENTROID}, {_EV}, {_SUP}, {_HL}, st AS (SELECT v.chunk_id, collection, round(least(1, greatest(0, 0.35 * ({_AGE})
  + 0.20 * (CASE WHEN ce.c IS NULL THEN 0 ELSE 1 - list_cosine_similarity(e, ce.c) END) + 0.30 * least(1, coalesce(ev.n, 0) / 3) + 0.15 * (CASE WHEN su.chunk_id IS NULL THEN 0 ELSE 1 END))), 9) AS s
  FROM v LEFT JOIN ce USING (cluster_id) LEFT JOIN ev USING (chunk_id) LEFT JOIN su USING (chunk_id) LEFT JOIN hl USING (collection)),
sl AS (SELECT *, CASE WHEN s < 0.3 THEN 'fresh' WHEN s < 0.6 THEN 'aging' WHEN s < 0.85 THEN 'stale' ELSE 'abandoned' END AS label FROM st)"""
SQL = {
    "triage_scored": f"WITH {_TRI} SELECT chunk_id, priority FROM tp",
    "triage_allowed": f"WITH {_TRI}, {_ALLOW} SELECT chunk_id, priority FROM al",
    "triage_summary": f"WITH {_TRI}, {_ALLOW} SELECT count(*) AS total, count(al.chunk_id) AS scanned FROM tp LEFT JOIN al USING (chunk_id)",
    "nli_candidates": f"WITH {_cand('')} SELECT chunk_a, chunk_b, round(cosine, 6) AS cosine FROM ca",
    "nli_candidates_budgeted": f"WITH {_TRI}, {_ALLOW}, {_cand('WHERE a IN (SELECT chunk_id FROM al)')} SELECT chunk_a, chunk_b, round(cosine, 6) AS cosine FROM ca",
    "nli_fused": f"""WITH {_cand('')}, ws AS (SELECT chunk_a, chunk_b, {SET.format('coalesce(x.text, chr(32))')} AS a, {SET.format('coalesce(y.text, chr(32))')} AS b FROM ca JOIN chunks x ON x.chunk_id = chunk_a JOIN chunks y ON y.chunk_id = chunk_b),
        sc AS (SELECT chunk_a, chunk_b, CASE WHEN len(a) = 0 THEN 0 ELSE round((len(a) - len(list_intersect(a, b))) / len(a), 6) END AS f,
          CASE WHEN len(b) = 0 THEN 0 ELSE round((len(b) - len(list_intersect(a, b))) / len(b), 6) END AS b FROM ws)
        SELECT chunk_a, chunk_b, CASE WHEN f > {HIT} AND b > {HIT} THEN 'both' WHEN f > {HIT} THEN 'a->b' ELSE 'b->a' END AS direction,
          round(CASE WHEN f > {HIT} AND b > {HIT} THEN greatest(f, b) WHEN f > {HIT} THEN f ELSE b END, 6) AS raw_score FROM sc WHERE f > {HIT} OR b > {HIT}""",
    "nli_retune_f05": f"WITH {_BEST} SELECT threshold, f, n_labels FROM bt",
    "nli_backfill": f"""WITH {_BEST} SELECT CASE WHEN raw_score >= threshold THEN 'calibrated' ELSE 'below_threshold' END AS calibration_state, count(*) AS n
        FROM c, bt WHERE detector = 'nli' AND raw_score IS NOT NULL GROUP BY 1""",
    "contradiction_evidence": f"WITH {_EV} SELECT chunk_id, n, round(least(1, n / 3), 6) AS evidence FROM ev",
    "superseded_flags": f"WITH {_SUP} SELECT chunk_id FROM su",
    "age_decay": f"WITH {_HL} SELECT chunk_id, round({_AGE}, 6) AS age_decay FROM chunks LEFT JOIN hl USING (collection) WHERE deleted_at IS NULL",
    "staleness_scored": f"WITH {_STALE} SELECT chunk_id, round(s, 4) AS staleness_score, label AS staleness_label FROM sl",
    "staleness_labels": f"WITH {_STALE} SELECT collection, label AS staleness_label, count(*) AS n FROM sl GROUP BY 1, 2",
    "staleness_page": """SELECT chunk_id, round(staleness_score, 4) AS staleness_score, staleness_components.age_decay AS age_decay, staleness_components.cluster_drift AS cluster_drift
        FROM chunks WHERE deleted_at IS NULL AND staleness_score IS NOT NULL AND staleness_label = 'stale' ORDER BY chunks.staleness_score DESC, chunk_id LIMIT 25 OFFSET 50""",
}
