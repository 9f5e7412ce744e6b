"""Problems 2 (near-duplicates) and 5 (batches against history)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.consolidate import hash_to_min
from corpuslens.llm.history import History, batches_of, groups_of
from corpuslens.llm.near import NearDuplicates
from corpuslens.session import remove, shared_dir
from corpuslens.sources.tables import load

RESEMBLANCE = 0.7


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(load(spark, d, "chunks").select("chunk_id", "text"), "chunk_id", "text", RESEMBLANCE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of chunks with a resemblance of at least 0.7."""
    return _near(spark, d).all_pairs().select(F.col("name_a").alias("chunk_a"), F.col("name_b").alias("chunk_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group of every chunk that has a near-duplicate."""
    return hash_to_min(_near(spark, d).links()).select("group_key", F.col("id").alias("chunk_id"))


def p5_found(spark: SparkSession, d: str, share: float = 0.1) -> DataFrame:
    """Intake records that resemble a chunk or an earlier accepted record.

    Consecutive batches are merged together until they hold ``share`` of the history's records;
    the cases do not depend on it.
    """
    h = History(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", RESEMBLANCE)
    h.load(load(spark, d, "chunks").filter("chunk_id is not null").select(F.xxhash64(F.lit("old"), "chunk_id").alias("id"), "text"))
    new = batches_of(load(spark, d, "intake_records"), "intake_id", ["batch_no", "intake_id"], "text")
    cases = new.limit(0).select("id")
    for lo, hi in groups_of(new, int(h.state["records"] * share)):
        cases = cases.unionByName(h.accept(new.filter(F.col("o1").between(lo, hi)).drop("rec")))
    h.close()
    remove(spark, h.path)
    return new.select("id", "rec").join(cases, "id").select(F.col("rec").alias("intake_id"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Records and cases by batch."""
    n = load(spark, d, "intake_records").select("intake_id", "batch_no")
    f = p5_found(spark, d).withColumn("is_case", F.lit(1))
    return n.join(f, "intake_id", "left").groupBy("batch_no").agg(F.count("*").alias("n_records"), F.sum(F.coalesce("is_case", F.lit(0))).alias("n_cases"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates, "p2_found": p2_found, "p2_groups": p2_groups}
_SETS = r"""t AS ({0}), w AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM t WHERE text IS NOT NULL),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 12),
e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id
  GROUP BY 1, 2 HAVING count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*)))"""
_P2 = _SETS.format("SELECT chunk_id AS id, text FROM chunks WHERE chunk_id IS NOT NULL")
# Records in order: k-th of the batches; the past and what was accepted so far decide.
_P5 = _SETS.format("""SELECT -row_number() OVER () AS id, text FROM chunks UNION ALL
  SELECT row_number() OVER (ORDER BY coalesce(batch_no, -1), intake_id), text FROM intake_records""") + """,
k AS (SELECT row_number() OVER (ORDER BY coalesce(batch_no, -1), intake_id) AS k, intake_id FROM intake_records),
q AS (SELECT k, intake_id, bool_or(a < 0) AS old, list(a) FILTER (a > 0) AS near FROM k LEFT JOIN p ON b = k GROUP BY ALL),
r(k, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT q.k, CASE WHEN coalesce(old, false) OR coalesce(list_has_any(near, taken), false) THEN taken ELSE list_append(taken, q.k) END FROM r JOIN q ON q.k = r.k + 1),
done AS (SELECT taken FROM r ORDER BY k DESC LIMIT 1),
found AS (SELECT intake_id FROM q, done WHERE NOT list_contains(taken, q.k))"""
SQL: dict[str, str] = {
    "p2_found": f"WITH {_P2} SELECT a AS chunk_a, b AS chunk_b FROM p",
    "p2_groups": f"""WITH RECURSIVE {_P2}, l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r(id, t) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.t = l.a)
        SELECT least(id, min(t)) AS group_key, id AS chunk_id FROM r GROUP BY id""",
    "p5_found": f"WITH RECURSIVE {_P5} SELECT intake_id FROM found",
    "p5_rates": f"""WITH RECURSIVE {_P5} SELECT batch_no, count(*) AS n_records, CAST(count(f.intake_id) AS BIGINT) AS n_cases
        FROM intake_records i LEFT JOIN found f USING (intake_id) GROUP BY 1""",
}
