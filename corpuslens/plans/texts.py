"""Text scalars, text dedup, numeric and version contradictions, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators.chunking import chunk_documents, nfkc
from corpuslens.operators.components import components
from corpuslens.operators.contradictions import active, numeric_hits, version_hits
from corpuslens.operators.groups import dense_ids, group_table
from corpuslens.operators.text_dedup import copies, similar_texts, text_edges
from corpuslens.session import Stage
from corpuslens.sources.tables import load

def _active(spark: SparkSession, d: str) -> DataFrame:
    return active(load(spark, d, "chunks"))


def text_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Number of words and of distinct shingles of each chunk."""
    c = load(spark, d, "chunks").withColumn("w", X.words("text"))
    return c.select("chunk_id", F.size("w").alias("n_words"), F.size(X.shingles_of(F.col("w"))).alias("n_shingles"))


def numbers_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Numbers by chunk."""
    return load(spark, d, "chunks").select("chunk_id", F.explode(X.numbers("text")).alias("number"))


def versions_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Versions by chunk."""
    return load(spark, d, "chunks").select("chunk_id", F.explode(X.versions("text")).alias("version"))


def masked_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the texts with numbers and with versions masked."""
    return load(spark, d, "chunks").select(
        "chunk_id", F.length(X.mask_numbers("text")).alias("n_numbers_masked"), F.length(X.mask_versions("text")).alias("n_versions_masked"))


def word_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of the canonical and each other member of the groups."""
    g = load(spark, d, "dedup_groups").select("canonical_chunk_id", F.explode("member_chunk_ids").alias("chunk_id")).filter(
        "chunk_id != canonical_chunk_id").distinct()
    t = load(spark, d, "chunks").select("chunk_id", X.word_set("text").alias("w"))
    j = g.join(t, "chunk_id").join(t.select(F.col("chunk_id").alias("canonical_chunk_id"), F.col("w").alias("cw")), "canonical_chunk_id")
    return j.select("canonical_chunk_id", "chunk_id", F.round(X.set_jaccard(F.col("w"), F.col("cw")), 6).alias("jaccard"))


def text_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different word sequences with a shingle similarity of at least 0.8."""
    return similar_texts(_active(spark, d)).select("vid_a", "vid_b", F.round("jaccard", 6).alias("jaccard"))


def text_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copy groups of two or more: the smallest id and the size."""
    return copies(_active(spark, d)).groupBy("vid").agg(F.count("*").alias("n")).filter("n > 1")


def text_dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicate texts with their canonical chunk and dense ids."""
    c = _active(spark, d)
    return dense_ids(group_table(text_edges(c), c)).select("group_id", "canonical_chunk_id", "n_members")


def dedup_merged_channels(spark: SparkSession, d: str) -> DataFrame:
    """Stored groups merged with text edges: members and channels of each resulting group."""
    c = _active(spark, d)
    ids = c.select("chunk_id")
    g = load(spark, d, "dedup_groups").filter(F.array_contains("detection_channels", "embedding"))
    m = g.select("canonical_chunk_id", F.explode("member_chunk_ids").alias("b")).select(F.col("canonical_chunk_id").alias("a"), "b").distinct()
    live = m.join(ids.select(F.col("chunk_id").alias("a")), "a").join(ids.select(F.col("chunk_id").alias("b")), "b").filter("a != b")
    e = live.withColumn("channel", F.lit("embedding")).unionByName(text_edges(c).withColumn("channel", F.lit("text")))
    e = Stage(spark, "merged-channels").put(e, "edges")  # its joins with all ids run once
    lab = components(e)
    ch = e.select(F.col("a").alias("id"), "channel").join(lab, "id").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    n = lab.groupBy("label").agg(F.count("*").alias("n_members"))
    return n.join(ch, "label").select(F.col("label").alias("group_key"), "n_members", "channels")


def numeric_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Numeric contradictions inside clusters of at most 50."""
    return numeric_hits(load(spark, d, "chunks"))


def version_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Version contradictions inside clusters of at most 50."""
    return version_hits(load(spark, d, "chunks"))


def numeric_contradictions_large(spark: SparkSession, d: str) -> DataFrame:
    """Numeric contradictions inside clusters of more than 50, which the scanner's rule leaves out."""
    return numeric_hits(load(spark, d, "chunks"), large=True)


def version_contradictions_large(spark: SparkSession, d: str) -> DataFrame:
    """Version contradictions inside clusters of more than 50."""
    return version_hits(load(spark, d, "chunks"), large=True)


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the cleaned documents."""
    t = load(spark, d, "documents")
    return nfkc(t.select("doc_id", "text")).select("doc_id", F.length(X.clean_spaces("text")).alias("n_clean"))


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the cleaned documents by size rules."""
    return chunk_documents(nfkc(load(spark, d, "documents").select("doc_id", "text")).withColumn("text", X.clean_spaces("text")))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunk names of the documents."""
    t = load(spark, d, "documents").filter("text is not null and source is not null")
    return t.select("doc_id", X.chunk_name(F.lower("source"), (F.col("doc_id") % 50 + 1).cast("int"), (F.col("doc_id") % 7).cast("int"), F.col("text")).alias("chunk_name"))


def slugify(spark: SparkSession, d: str) -> DataFrame:
    """Collection names from the sources."""
    s = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("name", F.col("source"))
    return nfkc(s, "name").select("source", "n", X.slug("name").alias("slug"))


QUERIES = {f.__name__: f for f in (
    text_shingles, numbers_extracted, versions_extracted, masked_texts, word_jaccard, text_jaccard_pairs, text_copies, text_dedup_groups, dedup_merged_channels,
    numeric_contradictions, version_contradictions, numeric_contradictions_large, version_contradictions_large, clean_text, chunk_text, chunk_ids, slugify)}
_WIDE = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"  # letters and numbers that the SQL engine's \b and \w don't know
_NUM, _VER = r"\b\d+(?:[.,]\d+)?\b", r"v?(\d+\.\d+(?:\.\d+)*)\b"
_T = f"regexp_replace(translate(coalesce(text, ''), '{X.DIGITS}', '{X.PLAIN_DIGITS}'), '({_WIDE})', '_\\1_', 'g')"  # wide signs stand between _
_PLAIN = f"regexp_replace({{}}, '_({_WIDE})_', '\\1', 'g')".replace("{L}", "{{L}}").replace("{N}", "{{N}}")
_NUMS = f"list_distinct(list_transform(regexp_extract_all({_T}, '{_NUM}', 0), lambda x: CAST(replace(x, ',', '') AS DOUBLE)))"
_VERS = f"list_distinct(regexp_extract_all({_T}, '(?i){_VER}', 1))"
_NMASK, _VMASK = (_PLAIN.format(f"regexp_replace({_T}, '{p}', '{m}', 'g')") for p, m in ((_NUM, "__NUM__"), (f"(?i){_VER}", "__VER__")))
SET = f"list_distinct(list_filter(regexp_split_to_array(lower({{}}), '{X.SPACE.replace('{', '{{').replace('}', '}}')}+'), lambda x: x <> ''))"
_JAC = "(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))))"
_W = r"""w AS (SELECT chunk_id, text, resolved_timestamp, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM chunks WHERE deleted_at IS NULL),
v AS (SELECT min(chunk_id) AS vid, any_value(w) AS w FROM w GROUP BY array_to_string(w, ' ')),
s AS (SELECT vid, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS sh FROM v),
e AS (SELECT vid, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.vid AS vid_a, b.vid AS vid_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM e a JOIN e b ON a.x = b.x AND a.vid < b.vid
  GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
cp AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY array_to_string(w, ' ')) AS vid FROM w),
te AS (SELECT vid_a AS a, vid_b AS b FROM p UNION SELECT vid, chunk_id FROM cp WHERE vid <> chunk_id)"""
_REACH = """ee AS (SELECT a, b FROM {0} UNION SELECT b, a FROM {0}),
r(id, t) AS (SELECT a, b FROM ee UNION SELECT r.id, ee.b FROM r JOIN ee ON r.t = ee.a),
lab AS (SELECT id, least(id, min(t)) AS label FROM r GROUP BY id)"""


def _pairs(feature: str, mask: str, hit: str, sizes: str = "BETWEEN 2 AND 50") -> str:
    return f"""WITH f AS (SELECT cluster_id, chunk_id, {feature} AS n, {SET.format(mask)} AS ctx FROM chunks WHERE deleted_at IS NULL AND cluster_id IS NOT NULL),
      k AS (SELECT cluster_id FROM f GROUP BY 1 HAVING count(*) {sizes})
      SELECT a.cluster_id, a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, {hit} AS raw_score
      FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.chunk_id < b.chunk_id JOIN k ON k.cluster_id = a.cluster_id
      WHERE len(a.n) > 0 AND len(b.n) > 0 AND list_sort(a.n) <> list_sort(b.n)
        AND coalesce({_JAC.format("a.ctx", "b.ctx")}, 1) >= 0.5"""


SQL = {
    "text_shingles": rf"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM chunks)
        SELECT chunk_id, CAST(len(w) AS INT) AS n_words, CAST(CASE WHEN len(w) < 3 THEN 1 ELSE
          len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) END AS INT) AS n_shingles FROM w""",
    "numbers_extracted": f"SELECT chunk_id, unnest({_NUMS}) AS number FROM chunks",
    "versions_extracted": f"SELECT chunk_id, unnest({_VERS}) AS version FROM chunks",
    "masked_texts": f"SELECT chunk_id, CAST(length({_NMASK}) AS INT) AS n_numbers_masked, CAST(length({_VMASK}) AS INT) AS n_versions_masked FROM chunks",
    "word_jaccard": f"""WITH g AS (SELECT DISTINCT canonical_chunk_id, unnest(member_chunk_ids) AS chunk_id FROM dedup_groups),
        t AS (SELECT chunk_id, {SET.format("coalesce(text, '')")} AS w FROM chunks)
        SELECT canonical_chunk_id, g.chunk_id, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 ELSE {_JAC.format("a.w", "b.w")} END, 6) AS jaccard
        FROM g JOIN t a ON a.chunk_id = g.chunk_id JOIN t b ON b.chunk_id = canonical_chunk_id WHERE g.chunk_id <> canonical_chunk_id""",
    "text_jaccard_pairs": f"WITH {_W} SELECT vid_a, vid_b, round(jaccard, 6) AS jaccard FROM p",
    "text_copies": f"WITH {_W} SELECT vid, count(*) AS n FROM cp GROUP BY 1 HAVING count(*) > 1",
    "text_dedup_groups": f"""WITH RECURSIVE {_W}, {_REACH.format("te")},
        m AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY resolved_timestamp DESC NULLS LAST, length(coalesce(text, '')) DESC, id) AS k,
          count(*) OVER (PARTITION BY label) AS n_members FROM lab JOIN w ON chunk_id = id)
        SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS group_id, id AS canonical_chunk_id, n_members FROM m WHERE k = 1""",
    "dedup_merged_channels": f"""WITH RECURSIVE {_W},
        g AS (SELECT DISTINCT canonical_chunk_id AS a, unnest(member_chunk_ids) AS b FROM dedup_groups WHERE list_contains(detection_channels, 'embedding')),
        ge AS (SELECT g.a, g.b, 'embedding' AS channel FROM g JOIN w x ON x.chunk_id = g.a JOIN w y ON y.chunk_id = g.b WHERE g.a <> g.b
          UNION ALL SELECT a, b, 'text' FROM te), {_REACH.format("ge")}
        SELECT label AS group_key, count(DISTINCT id) AS n_members, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels
        FROM lab LEFT JOIN ge ON ge.a = lab.id GROUP BY label""",
    "numeric_contradictions": _pairs(_NUMS, _NMASK, "round(1 - " + _JAC.format("a.n", "b.n") + ", 4)"),
    "version_contradictions": _pairs(_VERS, _VMASK, "1.0::DOUBLE"),
    "numeric_contradictions_large": _pairs(_NUMS, _NMASK, "round(1 - " + _JAC.format("a.n", "b.n") + ", 4)", "> 50"),
    "version_contradictions_large": _pairs(_VERS, _VMASK, "1.0::DOUBLE", "> 50"),
    "chunk_ids": """SELECT doc_id, format('{}-p{:03d}-c{:03d}-{}', lower(source), doc_id % 50 + 1, doc_id % 7, substr(sha1(text), 1, 8)) AS chunk_name
        FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""",
    "slugify": r"""WITH s AS (SELECT source, count(*) AS n, substr(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9_-]', '-', 'g'),
        '-{2,}', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 60) AS t FROM documents GROUP BY source),
        u AS (SELECT source, n, regexp_replace(CASE WHEN length(t) >= 3 THEN t WHEN t = '' THEN 'doc-pdf' ELSE 'doc-' || t END, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS t FROM s)
        SELECT source, n, CASE WHEN length(t) < 3 THEN 'documents' ELSE t END AS slug FROM u""",
}
