"""Connected components by contraction to minimum neighbours.

A round maps every vertex to the smallest vertex among itself and its neighbours, renames the ends
of all edges and keeps the distinct edges between different vertices; the graph shrinks by a
factor each round, however long its chains are. The maps are composed from the last round back,
so the full vertex set is joined only once. Minima are partially aggregated; each round is a
table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import Stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label) for each vertex of edges (a, b): label is the smallest id of its component.

    Null ends make no edge; a self edge makes a component of one; empty edges give no rows.
    """
    stage = Stage(edges.sparkSession, "components")
    e = stage.put(edges.select("a", "b").filter("a is not null and b is not null"), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("u")),
                                          F.struct(F.col("b").alias("id"), F.col("a").alias("u")))).alias("x")).select("x.*")
        least = stage.put(both.groupBy("id").agg(F.min("u").alias("u")).select("id", F.least("id", "u").alias("label")), f"map{len(maps)}")
        maps.append(least)
        to = lambda s: least.select(F.col("id").alias(s), F.col("label").alias(f"{s}2"))
        e = stage.replace(e.join(to("a"), "a").join(to("b"), "b").filter("a2 != b2").select(
            F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"components: edges left after {max_rounds} rounds")
    out = maps[-1]
    for m in reversed(maps[:-1]):
        nxt = out.select(F.col("id").alias("label"), F.col("label").alias("top"))
        out = m.join(nxt, "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    return out
