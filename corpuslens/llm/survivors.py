"""One surviving record per duplicate group, field by field.

Every attribute is one aggregate: the extreme of a composite struct (missing flag, source
priority, recency, ..., id, value) over the group's members, so all attributes of all groups come
from a single partially aggregated shuffle and no group is ever collected. Keys are negated
numbers, so ``min`` takes the greatest of each and the smallest id among ties.

Defined results: members that are null, repeated or unknown to the records don't count; a group
without usable member has no row; an attribute that no member has is null with a null id; an
empty input gives an empty table; extra columns of either side stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust in the origins of a timestamp, highest first (fixed values of the data model).
SOURCE_PRIORITY = {"metadata_field": 4, "uuid_v1": 3, "ulid": 2, "first_seen": 1}
BLANKS = " \t\r\n"


def memberships(groups: DataFrame) -> DataFrame:
    """(group_id, chunk_id) of canonical and members, each once."""
    ids = F.concat(F.array("canonical_chunk_id"), F.coalesce("member_chunk_ids", F.array().cast("array<string>")))
    return groups.select("group_id", F.explode(F.array_distinct(ids)).alias("chunk_id")).filter(
        F.col("chunk_id").isNotNull()).distinct()


def usable_records(chunks: DataFrame) -> DataFrame:
    """Live records with text, their text length and trusted time (microseconds, null if missing)."""
    stripped = F.regexp_replace("text", rf"^[{BLANKS}]+|[{BLANKS}]+$", "")
    ts = F.col("resolved_timestamp")
    bad = (ts == F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) | (ts > F.col("last_seen_by_pulse"))
    us = F.unix_micros(F.when(~F.coalesce(bad, F.lit(False)), ts).cast("timestamp"))
    return chunks.filter(F.col("deleted_at").isNull() & F.col("text").isNotNull()).withColumn(
        "text_length", F.length(stripped)).filter("text_length > 0").withColumn("time_us", us)


def best_of(keys: list[Column], value: Column | None, present: Column) -> Column:
    """struct of the first row under ascending keys among the present ones; null if none."""
    parts = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    return F.min(F.when(present, F.struct(*parts, *([value.alias("value")] if value is not None else []))))


def survivors(groups: DataFrame, chunks: DataFrame, attributes: list[str]) -> DataFrame:
    """(group_id, n_members, and <attribute>, <attribute>_chunk_id for each attribute).

    The most trusted origin wins, then the newest time, then the smallest id.
    """
    m, u = memberships(groups), usable_records(chunks)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]), F.col("timestamp_source")), F.lit(0))
    cols = list(dict.fromkeys(["chunk_id", "text_length", "time_us", "timestamp_source", *attributes]))
    j = m.join(u.select(*cols), "chunk_id")
    if "resolved_timestamp" in attributes:  # a time that counts as missing is no value either
        j = j.withColumn("resolved_timestamp", F.when(F.col("time_us").isNotNull(), F.col("resolved_timestamp")))
    j = j.withColumn("_rank", -rank).withColumn("_new", -F.coalesce("time_us", F.lit(-(2**62)).cast("long")))
    picks = []
    for a in attributes:
        lead = [-F.col("text_length")] if a == "text" else []
        picks.append(best_of([*lead, F.col("_rank"), F.col("_new"), F.col("chunk_id")], F.col(a), F.col(a).isNotNull()).alias(f"_{a}"))
    g = j.groupBy("group_id").agg(F.count("*").alias("n_members"), *picks)
    out = []
    for a in attributes:
        out += [F.col(f"_{a}")["value"].alias(a), F.col(f"_{a}")[f"k{3 if a == 'text' else 2}"].alias(f"{a}_chunk_id")]
    return g.select("group_id", "n_members", *out)


def best_members(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group_id, ts_chunk_id, text_chunk_id) of the groups with at least one usable time."""
    j = memberships(groups).join(usable_records(chunks).select("chunk_id", "text_length", "time_us"), "chunk_id")
    t, n, i = -F.col("time_us"), -F.col("text_length"), F.col("chunk_id")
    late = -F.coalesce("time_us", F.lit(-(2**62)).cast("long"))
    g = j.groupBy("group_id").agg(
        best_of([t, n, i], None, F.col("time_us").isNotNull()).alias("_t"), best_of([n, late, i], None, F.lit(True)).alias("_x"))
    return g.filter(F.col("_t").isNotNull()).select(
        "group_id", F.col("_t")["k2"].alias("ts_chunk_id"), F.col("_x")["k2"].alias("text_chunk_id"))
