"""Dedup groups from edges: components, canonical member, channels, dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.operators.components import components
from corpuslens.session import Stage


def group_table(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(label, canonical_chunk_id, n_members): groups of two or more.

    edges: (a, b). The canonical member has the newest time, then the longest text, then the
    smallest id; it is one aggregate, no group is collected.
    """
    c = components(edges)
    info = chunks.select("chunk_id", F.coalesce(F.unix_micros(F.col("resolved_timestamp").cast("timestamp")), F.lit(-(2**62)).cast("long")).alias("t"),
                         F.length(F.coalesce("text", F.lit(""))).alias("len"))
    j = c.join(info, c["id"] == info["chunk_id"])
    best = F.min(F.struct((-F.col("t")).alias("t"), (-F.col("len")).alias("l"), F.col("id")))
    return j.groupBy("label").agg(best.alias("m"), F.count("*").alias("n_members")).filter("n_members > 1").select(
        F.col("label"), F.col("m.id").alias("canonical_chunk_id"), "n_members")


def dense_ids(groups: DataFrame, label: str = "label") -> DataFrame:
    """group_id 0..n-1 in the order of the labels, without a single-task sort of all groups.

    The rows are cut into ranges of equal size by sampled quantiles of the label and staged in
    order; ranges are counted, the counts accumulated (one row a range), and rows numbered inside
    their range.
    """
    spark = groups.sparkSession
    stage = Stage(spark, "dense-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = groups.repartitionByRange(parts, label).sortWithinPartitions(label)
    g = stage.put(g.withColumn("_r", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() % (1 << 33)), "ranges")
    n = g.groupBy("_r").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("_b", before).select("_r", "_b")
    return g.join(F.broadcast(n), "_r").withColumn("group_id", (F.col("_k") + F.col("_b")).cast("int")).drop("_r", "_b", "_k")  # a row a range
