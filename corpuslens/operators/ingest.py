"""Snapshot diff of an incoming feed against the stored control table, and since-filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["store_id", "collection", "chunk_id"]


def latest_records(feed: DataFrame, settings: DataFrame) -> DataFrame:
    """Last delivery of each chunk with its store: the highest record_no wins."""
    last = feed.groupBy("collection", "chunk_id").agg(F.max(F.struct("record_no", "text")).alias("r"))
    store = settings.groupBy("collection").agg(F.max("store_id").alias("store_id"))
    return last.join(store, "collection").select("store_id", "collection", "chunk_id", F.col("r.text").alias("text"))


def snapshot_diff(incoming: DataFrame, stored: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """A row per chunk of either side with its status and next version.

    new, unchanged (same text), updated, deleted (active, absent, in a collection that delivered
    rows), absent (already deleted or its collection delivered nothing). Only texts decide.
    An unchanged chunk that was deleted stays deleted. whole: the collections that were read to
    their end; nothing is deleted in others.
    """
    inc = incoming.select(*KEY, F.md5(F.coalesce("text", F.lit(""))).alias("new_hash"), F.lit(True).alias("seen"))
    old = stored.select(*KEY, F.md5(F.coalesce("text", F.lit(""))).alias("old_hash"), "version", "deleted_at", F.lit(True).alias("known"))
    delivered = incoming.select("store_id", "collection").distinct().withColumn("delivered", F.lit(True))
    if whole is not None:
        delivered = delivered.join(whole.select("collection").distinct(), "collection", "left_semi")
    j = inc.join(old, KEY, "full_outer").join(delivered, ["store_id", "collection"], "left")
    status = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("seen").isNull(), F.when(F.col("deleted_at").isNull() & F.coalesce("delivered", F.lit(False)), "deleted").otherwise("absent"))
        .when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("updated"))
    version = F.when(status == "new", 1).when(status == "updated", F.coalesce("version", F.lit(1)) + 1).otherwise(F.col("version"))
    return j.select(*KEY, status.alias("status"), version.cast("int").alias("next_version"))


def since(feed: DataFrame, ts: Column, moment: str) -> DataFrame:
    """Drops a row only if its time is readable and before the moment."""
    return feed.filter(ts.isNull() | (ts >= F.lit(moment).cast("timestamp")))


def apply_diff(diff: DataFrame, incoming: DataFrame, stored: DataFrame, now: str) -> DataFrame:
    """The next snapshot of the control table: inserts, touches, updates and soft deletes."""
    t = F.lit(now).cast("timestamp_ntz")
    inc = incoming.select(*KEY, F.col("text").alias("new_text"))
    old = stored.select(*KEY, "text", "first_seen_by_pulse", "last_seen_by_pulse", "deleted_at")
    j = diff.join(inc, KEY, "left").join(old, KEY, "left")
    s = F.col("status")
    return j.select(
        *KEY, F.when(s.isin("new", "updated"), F.col("new_text")).otherwise(F.col("text")).alias("text"),
        F.coalesce("first_seen_by_pulse", t).alias("first_seen_by_pulse"),
        F.when(s.isin("new", "updated", "unchanged"), t).otherwise(F.col("last_seen_by_pulse")).alias("last_seen_by_pulse"),
        F.when(s == "updated", None).when(s == "deleted", t).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.col("next_version").alias("version"))
