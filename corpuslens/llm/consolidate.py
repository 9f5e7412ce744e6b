"""Pairwise matches to groups by hash-to-min.

State: rows (v, u) with u in the cluster set of v, both ways. A round takes m(v), the smallest
member of each set, and sends the set to m and m to all its members: (m, u) and (u, m) for every u
of v. A component is stable once the set of its smallest vertex r has only members whose own set is
r alone; it then retires to the result and is never rewritten, and the rounds end when nothing is
left. Sets live as rows, never as one array in one task: minimum and size are partially
aggregated and a hot v is an ordinary skewed join key (AQE splits it). Each round is written to
the shared folder and the round before it is deleted.

Defined results: null ends and self links make no link (such a record alone has no row);
repeated and reversed links count once; empty input gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import Stage


def links_of_groups(groups: DataFrame, canonical: str, members: str) -> DataFrame:
    """(a, b) star links of each group's canonical and members; lists of one give none."""
    ids = F.array_distinct(F.filter(F.concat(F.array(canonical), F.coalesce(members, F.array().cast("array<string>"))),
                                    lambda x: x.isNotNull()))
    return groups.select(ids.alias("_m")).filter(F.size("_m") > 1).select(
        F.col("_m")[0].alias("a"), F.explode(F.slice("_m", 2, F.size("_m") - 1)).alias("b"))


def hash_to_min(links: DataFrame, a: str | Column = "a", b: str | Column = "b", max_rounds: int = 60) -> DataFrame:
    """(group_key, id): one row per linked id with the smallest id of its component."""
    spark = links.sparkSession
    stage = Stage(spark, "hash-to-min")
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    e = links.select(a.alias("v"), b.alias("u")).filter(F.col("v").isNotNull() & F.col("u").isNotNull() & (F.col("v") != F.col("u")))
    both = e.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("x")).select("x.*")
    state, left = stage.put_counted(both.distinct(), "state")
    done = state.select(F.col("v").alias("group_key"), F.col("u").alias("id")).limit(0)
    for k in range(max_rounds):
        if not left:
            return done
        least = state.groupBy("v").agg(F.min("u").alias("u"), F.count("*").alias("n"))
        if k < 4 or k % 2 == 0:  # the checks that retire stable components
            least = stage.replace(least, "least")
            leaves = least.filter("n = 1 and u < v").groupBy(F.col("u").alias("r")).agg(F.count("*").alias("n"))
            roots = leaves.join(least.filter("u > v").select(F.col("v").alias("r"), "n"), ["r", "n"]).select("r")
            stars = least.select(F.least("v", "u").alias("r"), F.col("v").alias("id")).join(roots, "r")
            stars = stage.put(stars.select(F.col("r").alias("group_key"), "id"), f"stars{k}")
            done = done.unionByName(stars)
            gone = stars.select(F.col("id").alias("v"))
            state, least = state.join(gone, "v", "left_anti"), least.join(gone, "v", "left_anti")
        # m(v) covers v itself, which is a member of its own set.
        sent = state.join(least.select("v", F.least("v", "u").alias("m")), "v").select(F.explode(F.array(
            F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
            F.struct(F.col("m").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("m").alias("u")),
        )).alias("x")).select("x.*").filter("v != u").distinct()
        state, left = stage.replace_counted(sent, "state")
    raise RuntimeError(f"hash_to_min: not stable after {max_rounds} rounds")
