"""Contradiction detectors and candidates inside clusters, fusion of directions, feedback, review views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions import scores, text
from corpuslens.operators.text_dedup import prefixes
from corpuslens.session import Stage

DETECTOR_CAP = 50


def active(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("deleted_at").isNull())


def cluster_pairs(chunks: DataFrame, columns: list[str], cap: int = DETECTOR_CAP, needed: str | None = None) -> DataFrame:
    """All pairs a < b of clusters of 2 to cap active members; larger clusters are skipped.

    Sizes are counted first (partially aggregated) and oversize clusters never reach the join, so
    a cluster gives at most cap * (cap - 1) / 2 pairs. Features are per chunk, not per pair.
    """
    c = active(chunks).filter("cluster_id is not null").select("cluster_id", "chunk_id", *columns)
    sized = c.groupBy("cluster_id").agg(F.count("*").alias("_n")).filter(F.col("_n").between(2, cap)).select("cluster_id")
    c = c.join(sized, "cluster_id")
    if needed:  # after the count: members without a feature make a cluster as large as any
        c = c.filter(F.size(needed) > 0)
    side = lambda s: c.select("cluster_id", F.col("chunk_id").alias(f"chunk_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in columns])
    return side("a").join(side("b"), "cluster_id").filter("chunk_a < chunk_b")


def alike_pairs(chunks: DataFrame, columns: list[str], context: str, needed: str, least: float = 0.5, cap: int = DETECTOR_CAP) -> DataFrame:
    """The pairs of clusters of more than cap active members whose context sets have a Jaccard similarity of at least ``least``.

    The exact way for what ``cluster_pairs`` skips: a set-similarity join inside the cluster on the
    rarest words of each context, so a cluster never has all its pairs listed. Empty contexts pair
    with nothing.
    """
    c = active(chunks).filter("cluster_id is not null").select("cluster_id", "chunk_id", *columns)
    large = c.groupBy("cluster_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > cap).select("cluster_id")
    c = Stage(chunks.sparkSession, "large-clusters").put(c.join(large, "cluster_id").filter((F.size(needed) > 0) & (F.size(context) > 0)), "members")
    v = c.select(F.col("chunk_id").alias("vid"), F.size(context).alias("n"), F.transform(context, lambda x: F.xxhash64(x)).alias("sh"))
    p = prefixes(v, least).join(c.select(F.col("chunk_id").alias("vid"), "cluster_id"), "vid")
    side = lambda s: p.select("cluster_id", "s", F.col("vid").alias(f"chunk_{s}"), F.col("n").alias(f"n_{s}"))
    fits = (F.col("n_a") >= F.col("n_b") * least) & (F.col("n_b") >= F.col("n_a") * least)
    pairs = side("a").join(side("b"), ["cluster_id", "s"]).filter((F.col("chunk_a") < F.col("chunk_b")) & fits).select("cluster_id", "chunk_a", "chunk_b").distinct()
    for s in "ab":
        pairs = pairs.join(c.select(F.col("chunk_id").alias(f"chunk_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in columns]), f"chunk_{s}")
    return pairs


def _hits(f: DataFrame, feature: str, score: Callable[..., Column], large: bool) -> DataFrame:
    p = alike_pairs(f, [feature, "ctx"], "ctx", feature) if large else cluster_pairs(f, [feature, "ctx"], needed=feature)
    s = score(*(F.col(x) for x in (f"{feature}_a", f"{feature}_b", "ctx_a", "ctx_b")))
    return p.select("cluster_id", "chunk_a", "chunk_b", s.alias("raw_score")).filter("raw_score is not null")


def numeric_hits(chunks: DataFrame, large: bool = False) -> DataFrame:
    """Numeric contradictions in clusters of at most DETECTOR_CAP members; large: in the others."""
    f = chunks.withColumn("nums", text.numbers("text")).withColumn("ctx", text.word_set(text.mask_numbers("text")))
    return _hits(f, "nums", text.numeric_contradiction, large)


def version_hits(chunks: DataFrame, large: bool = False) -> DataFrame:
    """Version contradictions in clusters of at most DETECTOR_CAP members; large: in the others."""
    f = chunks.withColumn("vers", text.versions("text")).withColumn("ctx", text.word_set(text.mask_versions("text")))
    return _hits(f, "vers", text.version_contradiction, large)


def group_pairs(groups: DataFrame) -> DataFrame:
    """(group_id, member) rows; two ids are a dedup pair if they share a group."""
    return groups.select("group_id", F.explode(F.array_distinct("member_chunk_ids")).alias("chunk_id")).filter("chunk_id is not null").distinct()


def candidates(pairs: DataFrame, groups: DataFrame, threshold: float, k: int, allowed: DataFrame | None = None, members: bool = False) -> DataFrame:
    """Pairs to be judged: top k by cosine for each query, over the threshold, minus dedup pairs, unordered.

    pairs: (a, b, cosine), both directions. Dedup pairs are removed after the top k, so they use
    up places. allowed: chunk ids that may be queries; neighbours are not restricted. members:
    groups has a row per member (group_id, chunk_id) instead of lists.
    """
    if allowed is not None:
        pairs = pairs.join(allowed.select(F.col("chunk_id").alias("a")), "a", "left_semi")
    w = W.partitionBy("a").orderBy(F.desc("cosine"), F.desc("b"))
    top = pairs.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= k) & (F.col("cosine") > threshold))
    m = groups.select("group_id", "chunk_id").distinct() if members else group_pairs(groups)
    dup = top.select("a", "b").join(m.select("group_id", F.col("chunk_id").alias("a")), "a").join(
        m.select("group_id", F.col("chunk_id").alias("b")), ["group_id", "b"]).select("a", "b").distinct()
    left = top.join(dup, ["a", "b"], "left_anti")
    return left.groupBy(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")).agg(F.max("cosine").alias("cosine"))


def fuse(scored: DataFrame, threshold: float) -> DataFrame:
    """Direction and score of the pairs that are contradictory in at least one direction."""
    f, b = F.col("forward") > threshold, F.col("backward") > threshold
    return scored.filter(f | b).withColumn(
        "direction", F.when(f & b, "both").when(f, "a->b").otherwise("b->a")).withColumn(
        "raw_score", F.when(f & b, F.greatest("forward", "backward")).when(f, F.col("forward")).otherwise(F.col("backward")))


def lexical_scores(pairs: DataFrame) -> DataFrame:
    """A deterministic stand-in for a pair model: share of the other side's words a text lacks."""
    a, b = text.word_set("text_a"), text.word_set("text_b")
    lack = lambda x, y: F.when(F.size(x) == 0, 0.0).otherwise(F.round(F.size(F.array_except(x, y)) / F.size(x), 6))
    return pairs.withColumn("forward", lack(a, b)).withColumn("backward", lack(b, a))


def model_scores(pairs: DataFrame, predict: Callable[[list[tuple[str, str]]], list[dict]], batch: int = 64) -> DataFrame:
    """Scores of a user's pair model in both directions; the label contradiction is required."""
    def one(ts: list[tuple[str, str]]) -> list[float]:
        out = []
        for i in range(0, len(ts), batch):
            for r in predict(ts[i : i + batch]):
                if "contradiction" not in r:
                    raise ValueError("the model gives no label 'contradiction'")
                out.append(float(r["contradiction"]))
        return out

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            f = one(list(zip(p["text_a"].fillna(""), p["text_b"].fillna(""))))
            b = one(list(zip(p["text_b"].fillna(""), p["text_a"].fillna(""))))
            yield p.assign(forward=f, backward=b)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{fields}, forward double, backward double")


def best_threshold(labelled: DataFrame, beta: float = 0.5, least: int = 5) -> DataFrame:
    """One row (threshold, f, n_labels): the score cut with the best F-beta; ties: the lowest cut.

    labelled: (score, positive BOOLEAN). Fewer than ``least`` labels, or no cut with f > 0: 0.5.
    Counts are aggregated by distinct score first; the cumulative sums run over those.
    """
    s = labelled.filter("score is not null and positive is not null").groupBy("score").agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.count("*").alias("n"))
    w = W.orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = s.select("score", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("all"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("n_labels"))
    f = scores.f_beta(F.col("tp") / F.col("all"), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0), beta)
    best = t.withColumn("f", F.round(f, 12)).agg(F.max(F.when(F.col("f") > 0, F.struct("f", (-F.col("score")).alias("s")))).alias("m"), F.max("n_labels").alias("n_labels"))
    ok = F.col("m").isNotNull() & (F.col("n_labels") >= least)
    return best.select(F.when(ok, -F.col("m.s")).otherwise(0.5).alias("threshold"), F.round(F.when(ok, F.col("m.f")).otherwise(0.0), 6).alias("f"),
                       F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def pair_key(df: DataFrame) -> DataFrame:
    return df.withColumn("a", F.least("chunk_a", "chunk_b")).withColumn("b", F.greatest("chunk_a", "chunk_b"))


def state_filter(state: str | None) -> Column:
    r = F.col("user_resolution")
    return {"unresolved": r.isNull(), "resolved": r.isNotNull()}.get(state or "", F.lit(True))


def review_view(contra: DataFrame, chunks: DataFrame, run: str | None = None, state: str | None = None, detector: str | None = None) -> DataFrame:
    """One row per unordered pair with the signals of all its detectors, joined with both texts.

    The detector restricts pairs, not signals: it is a condition on the group.
    """
    c = contra.filter("chunk_a is not null and chunk_b is not null")
    if run:
        c = c.filter(F.col("scan_run_id") == run)
    c = pair_key(c.filter(state_filter(state)))
    of = lambda d, x: F.max(F.when(F.col("detector") == d, F.col(x)))
    g = c.groupBy("a", "b").agg(
        F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"),
        of("nli", "raw_score").alias("nli_score"), of("numeric", "raw_score").alias("numeric_score"), of("version", "raw_score").alias("version_score"),
        F.max("raw_score").alias("max_score"), F.max("user_resolution").alias("user_resolution"), F.max("scan_run_id").alias("last_run"),
        *([F.max((F.col("detector") == detector).cast("int")).alias("_d")] if detector else []))
    if detector:
        g = g.filter("_d = 1").drop("_d")
    t = chunks.select("chunk_id", "collection", text.preview("text", 300).alias("preview"))
    for s in "ab":
        g = g.join(t.select(F.col("chunk_id").alias(s), F.col("collection").alias(f"collection_{s}"), F.col("preview").alias(f"preview_{s}")), s, "left")
    return g


def resolve(contra: DataFrame, verdicts: DataFrame, now: str) -> DataFrame:
    """Writes verdicts (chunk_a, chunk_b, resolution) onto all rows of a pair, in either order."""
    v = pair_key(verdicts).groupBy("a", "b").agg(F.max("resolution").alias("_v"))
    return pair_key(contra).join(v, ["a", "b"], "left").withColumn(
        "user_resolution", F.coalesce("_v", "user_resolution")).withColumn(
        "resolved_at", F.when(F.col("_v").isNotNull(), F.lit(now).cast("timestamp_ntz"))).drop("_v", "a", "b")
