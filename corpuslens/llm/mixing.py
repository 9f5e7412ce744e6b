"""Combining sources to target shares of the total size in tokens.

Weighted sampling without replacement by exponential keys (Efraimidis and Spirakis): a document
of weight w has the key -ln(u)/w, u from a hash of its id; a source's documents are taken in
ascending order of the key until its budget is used up, the last one if at least half of it fits
(so a source misses its budget by half a document at most). A source whose budget exceeds its size
first gives whole epochs, then the fraction left is selected by key.

The prefix sums are two-level, so that a source with a third of all rows is no single task: a
monotone image of the key is cut into BUCKETS ranges, ranges are summed (partially aggregated)
and accumulated over at most BUCKETS rows a source, and only inside a range are documents sorted.

The total of a mix, unless given, is the largest at which every source that has tokens can give
its share under its cap (all caps null: the size of its sources). Sources without documents give
nothing and the other shares are relative to the rest; the report has them with actual share 0.

Defined results: rows without mix or source and shares that are null, zero or negative are dropped; a null cap is no cap; caps
under 1 exclude the source; repeated target rows of a source in a mix count once (largest share);
null texts have no tokens and are never chosen; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from corpuslens.session import Stage

BUCKETS = 4096


def source_name(c: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def quality_weight(text: str) -> Column:
    """Share of letters in the text, at least 0.05."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.length(text), F.lit(1)))


def measured(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, quality: Column | None = None) -> DataFrame:
    """(doc_id, source, w, n_tokens), written once: texts are encoded one time.

    quality: weight of each document, at least 1e-6 (null: 1e-6); the share of letters if not given.
    """
    w = quality_weight("text") if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-6))
    d = documents.select("doc_id", source_name("source").alias("source"), w.alias("w"), "text")
    n = count_tokens(d.filter(F.col("source").isNotNull() & F.col("text").isNotNull()), vocabulary=vocabulary).drop("text")
    return Stage(documents.sparkSession, "mixing").put(n.filter("n_tokens > 0"), "documents")


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """A row per mix and source: available tokens, budget, whole epochs and the rest."""
    t = targets.filter("target_share > 0 and coalesce(max_repeats, 1) >= 1 and mix_name is not null and source is not null").groupBy(
        "mix_name", source_name("source").alias("source")).agg(
        F.max("target_share").alias("share"), F.max(F.struct("target_share", "max_repeats"))["max_repeats"].alias("cap"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_documents"))
    j = t.join(have, "source", "left").fillna(0, ["available", "n_documents"])
    mix = W.partitionBy("mix_name")  # rows of targets, not of documents
    full = F.col("available") > 0
    j = j.withColumn("target", F.col("share") / F.sum("share").over(mix)).withColumn(
        "q", F.when(full, F.col("share")).otherwise(0.0) / F.sum(F.when(full, F.col("share")).otherwise(0.0)).over(mix))
    room = F.min(F.when(full & F.col("cap").isNotNull(), F.col("available") * F.col("cap") / F.col("q"))).over(mix)
    total = F.lit(float(total_tokens)) if total_tokens else F.coalesce(room, F.sum("available").over(mix).cast("double"))
    want = F.col("q") * F.col("total")
    top = F.when(F.col("cap").isNull(), want).otherwise(F.least(want, F.col("available") * F.col("cap").cast("double")))
    # 1e-9: a budget that fills the cap is whole epochs in spite of rounding.
    return j.withColumn("total", total).withColumn("budget", F.when(full, top).otherwise(0.0)).withColumn(
        "epochs", F.when(full, F.floor(F.col("budget") / F.col("available") + 1e-9)).otherwise(0)).withColumn(
        "rest", F.when(full, F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("available"))).otherwise(0.0))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7,
        vocabulary: str = DEFAULT_VOCABULARY, quality: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with repeats, report of the shares)."""
    docs = measured(documents, vocabulary, quality)
    plan = budgets(docs, targets, total_tokens)
    u = ((F.xxhash64("doc_id", "mix_name", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) + F.lit(0.5)) / F.lit(float(1 << 52))
    d = docs.join(plan.filter("available > 0").select("mix_name", "source", "epochs", "rest"), "source")
    # 1 - u^(1/w) rises with -ln(u)/w and lies in [0, 1).
    d = d.withColumn("key", 1 - F.pow(u, 1 / F.col("w"))).withColumn(
        "bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("key") * BUCKETS)).cast("int"))
    cells = d.groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(cells.withColumn("_before", before).drop("_n"), ["mix_name", "source", "bucket"])
    upto = F.col("_before") + F.sum("n_tokens").over(
        W.partitionBy("mix_name", "source", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    fits = (F.col("rest") > 1e-6) & (upto - F.col("n_tokens") / 2 <= F.col("rest"))
    d = d.withColumn("repeats", (F.col("epochs") + fits.cast("int")).cast("int"))
    chosen = d.filter("repeats > 0").select("mix_name", "source", "doc_id", "repeats", "n_tokens")
    got = chosen.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_chosen"), F.max("repeats").alias("most_repeats"))
    r = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "n_chosen", "most_repeats"])
    share = F.col("tokens") / F.sum("tokens").over(W.partitionBy("mix_name"))
    report = r.select("mix_name", "source", F.col("target").alias("target_share"), "cap", "n_documents", "available",
                      F.round("budget", 3).alias("budget"), "n_chosen", "most_repeats", "tokens", share.alias("actual_share"))
    return chosen, report
