"""Similarity clusters by grids: quantise, count cells, join adjacent dense cells, propagate minimum labels.

Each grid quantises the (rotated) vectors into cells, which are counted over all rows; inside a
cell the records with a cosine over the cut form fragments, the dense parts of the cell, verified
by their vectors. Fragments of different cells that share a record are adjacent and joined, and
the minimum label is propagated over the joined fragments until nothing changes. Clusters of fewer
than ``min_size`` records are no clusters.

Grids come in passes of GRIDS. The first pass gives labels; each further one looks for links
between different labels, and the passes end with the first that finds fewer than one in
``1 / SETTLED`` records (at most ``passes``): tight clusters are whole after one, and records with
a single link at the cut are what the others find. A pass misses a link at a cosine of 0.82 with
a probability of 0.04 before refinement, 0.25 at 1 024 cells.

Defined results: records with null, short, non-finite or zero vectors and null ids belong to no
cluster; redelivered rows of an id count once; identical vectors are linked; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.links import cell_links, exact_links
from corpuslens.operators.components import components
from corpuslens.operators.grids import distinct_vectors, good, gridded
from corpuslens.session import Stage, ship

GRIDS, PROBES, PASSES, SETTLED = 3, 2, 8, 2e-3


class Labels:
    """Labels of all records with at least one link, and the fragments of the first pass."""

    def __init__(self, records: DataFrame, idc: str, vector: str, cut: float, dim: int = 64, passes: int = PASSES, stage: Stage | None = None):
        spark = records.sparkSession
        self.stage = stage or Stage(spark, "clusters")
        self._source, self._cut, self._dim = (records, idc, vector), cut, dim
        every = self.stage.put(distinct_vectors(records, idc, vector, dim), "directions")
        one = self.stage.put(every.groupBy("h").agg(F.min(F.struct("id", "v")).alias("r")).select("h", "r.*"), "vectors")
        self.twins = self.stage.put(every.select("h", "id").join(one.select("h", F.col("id").alias("rep")), "h").filter(
            "id != rep").select("rep", "id").distinct(), "twins")
        self.stage.done("directions")
        rows = one.count()
        self._parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * GRIDS * PROBES // 150_000)
        self.fragments = self._links(one, 0, rows)
        sure = self._sure(self.fragments)
        # A record has one fragment a grid, probe and block (and its few doubtful links).
        mine = self.stage.put(sure.groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("f")), "fragments")
        lowest = F.array_min(F.array_append("f", F.col("id")))
        top = components(mine.select(lowest.alias("a"), F.explode(F.array_append("f", F.col("id"))).alias("b")).distinct())
        first = mine.select("id", lowest.alias("low")).join(top.select(F.col("id").alias("low"), "label"), "low").select("id", "label")
        self._label = self.stage.put(first, "labels")
        self.stage.done("fragments")
        for p in range(1, passes):
            if self._joined(self._links(one, p, rows)) <= SETTLED * rows:
                break
        self.stage.done("vectors")

    def _links(self, vectors: DataFrame, p: int, rows: int) -> DataFrame:
        cells = gridded(vectors, self._dim, list(range(p * GRIDS, (p + 1) * GRIDS)), rows, PROBES)
        return self.stage.put(cell_links(cells, self._dim, self._cut, self._parts), f"links{p}")

    def _sure(self, links: DataFrame) -> DataFrame:
        sure, doubt = links.filter("sure").select("a", "b"), links.filter("not sure").select("a", "b").distinct()
        return sure if doubt.isEmpty() else sure.unionByName(exact_links(doubt, *self._source, self._dim, self._cut))

    def _joined(self, links: DataFrame) -> int:
        """Joins the labels that links connect; the number of such links between labels."""
        of = lambda s: self._label.select(F.col("id").alias(s), F.col("label").alias(f"l{s}"))
        j = self._sure(links).filter("a != b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        new = j.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b").distinct()
        new = self.stage.put(new, f"new{self.stage.n}")
        n = new.count()
        if n:
            top = self.stage.put(components(new), f"top{self.stage.n}")
            old = self._label.join(top.select(F.col("id").alias("label"), F.col("label").alias("t")), "label", "left").select("id", F.coalesce("t", "label").alias("label"))
            lone = top.join(self._label.select("id"), "id", "left_anti")  # had no link before
            self._label = self.stage.replace(old.unionByName(lone), "labels")
        return n

    def labels(self) -> DataFrame:
        """(id, label): hashed ids; label: one id of the cluster."""
        t = self.twins.join(self._label.select(F.col("id").alias("rep"), "label"), "rep", "left").select("rep", "id", F.coalesce("label", "rep").alias("label"))
        return self._label.unionByName(t.select("id", "label")).unionByName(t.select(F.col("rep").alias("id"), "label")).distinct()


def clusters(records: DataFrame, idc: str, vector: str, cut: float, min_size: int = 8, dim: int = 64, found: Labels | None = None) -> DataFrame:
    """(cluster_key, name, size, id, label): members of each cluster; cluster_key: its smallest name."""
    found = found or Labels(records, idc, vector, cut, dim)
    stage = found.stage
    lab = stage.put(found.labels(), "all-labels")
    big = lab.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    names = records.filter(F.size(vector) == dim).select(F.xxhash64(idc).alias("id"), F.col(idc).alias("name")).distinct()
    member = stage.put(lab.join(big, "label").join(names, "id").select("label", "name", "size", "id"), "members")
    key = member.groupBy("label").agg(F.min("name").alias("cluster_key"))
    return member.join(key, "label").select("cluster_key", "name", "size", "id", "label")


def typical_members(records: DataFrame, idc: str, vector: str, cut: float, top: int = 3, min_size: int = 8, dim: int = 64) -> DataFrame:
    """(cluster_key, size, rank, chunk_id, fit): members of each cluster's densest cell.

    The densest cell holds the cluster's largest fragment (ties: the smallest cell). Its members
    are ranked by fit, the mean cosine with all members of the cluster: the product with their
    mean, a partially aggregated sum of the unit vectors. Clusters of copies only have no
    fragment; then all members count.
    """
    spark = records.sparkSession
    ship(spark)
    found = Labels(records, idc, vector, cut, dim)
    stage = found.stage
    m = stage.put(clusters(records, idc, vector, cut, min_size, dim, found), "named")
    f = found.fragments.filter("sure")
    size = f.groupBy("cell", "a").agg(F.count("*").alias("n")).join(m.select(F.col("id").alias("a"), "label").distinct(), "a")
    dense = size.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "cell", "a")).alias("d")).select("label", "d.cell", "d.a")
    chosen = f.join(dense, ["cell", "a"]).select(F.col("b").alias("id")).distinct().withColumn("chosen", F.lit(1))
    m = m.join(chosen, "id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, u = good(b.column(1), dim)
            flat = pa.array(np.round(u, 9).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, dim, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), lists], names=["id", "u"])

    src = records.filter(F.size(vector) == dim).select(F.xxhash64(idc).alias("id"), vector)
    u = src.mapInArrow(unit, "id long, u array<double>").dropDuplicates(["id"])
    j = stage.put(m.join(u, "id"), "unit")
    mean = j.groupBy("cluster_key").agg(*[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dim)], F.max("chosen").alias("some"))
    mean = mean.select("cluster_key", "some", F.array(*[F.col(f"s{i}") for i in range(dim)]).alias("s"))
    fit = F.aggregate(F.zip_with("u", "s", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.col("size")
    scored = j.join(mean, "cluster_key").filter("chosen = some").select("cluster_key", "size", "name", F.round(fit, 6).alias("fit"))
    w = W.partitionBy("cluster_key").orderBy(F.desc("fit"), "name")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(
        "cluster_key", "size", "rank", F.col("name").alias("chunk_id"), "fit")
