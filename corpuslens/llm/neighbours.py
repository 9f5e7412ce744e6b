"""Most similar vectors of every vector: a robust-pruned directed graph in each shard.

1. Sharding: records linked (directly or through others) at the threshold belong together, and no
   wanted pair crosses two such groups; the groups come from the grids of ``clusters``.
2. In each shard a directed graph is built: greedy searches from the shard's entry propose
   neighbours, pruning with a relaxed distance (alpha 1.2) keeps diverse edges.
3. Every record is a query: a beam search in each of its shards, the best k of all shards.
4. The cosines of what is found are computed in double precision from the stored vectors.

Groups of more than GRAPH_ROWS records are searched by matrix products instead of steps 2 and 3:
a beam narrow enough to be worth its cost loses neighbours there (figures in the README). A group
of more than SHARD_ROWS is cut into parts by id and each pair of parts is a shard, so that every
two of its records meet; its cost grows with the square of the group.

``search`` answers a stated set of queries against all records without a threshold: every shard of
a hash partition has a graph, and each query searches all of them.

Measured against brute force, see the README. Defined results: as in ``clusters``; a record has
fewer than k neighbours if fewer reach the threshold; equal cosines (to 1e-12) are ordered by
name; identical vectors are neighbours with cosine 1, and of many of them only the k + 1 smallest
names enter a graph, since no row can have another of them among its best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.clusters import Labels
from corpuslens.llm.graph import Graph
from corpuslens.operators.grids import good
from corpuslens.session import Stage, ship

GRAPH_ROWS, SHARD_ROWS, PACK_ROWS = 512, 8192, 16384


def _stored(records: DataFrame, idc: str, vector: str, dim: int) -> DataFrame:
    """(id, name, x): good vectors, x as bytes of the stored floats, halved where that is exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, _ = good(b.column(2), dim)
            at = pa.array(ok)
            col = b.column(2).take(at)
            flat = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
            flat = flat.reshape(-1, dim)
            with np.errstate(over="ignore"):
                half = flat.astype(np.float16)
            exact = (half == flat).all(1)
            raw = pa.array([h.tobytes() if e else f.tobytes() for h, f, e in zip(half, flat, exact)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), raw], names=["id", "name", "x"])

    ship(records.sparkSession)
    src = records.filter(F.col(idc).isNotNull() & (F.size(vector) == dim)).select(F.xxhash64(idc).alias("id"), F.col(idc).alias("name"), vector)
    return src.mapInArrow(run, "id long, name string, x binary")


def _floats(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision of stored bytes."""
    v = np.array([np.frombuffer(r, np.float16 if len(r) == 2 * dim else np.float32) for r in raw], np.float64).reshape(-1, dim)
    v /= np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def _cut(stored: DataFrame) -> DataFrame:
    """(shard, id, name, x): groups of several parts by pairs of their parts."""
    n, i, j = F.col("parts"), F.pmod(F.xxhash64("id", F.lit(17)), F.col("parts")), F.col("other")
    cut = stored.filter("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).filter(i != j)
    return cut.select(F.xxhash64("label", F.least(i, j), F.greatest(i, j)).alias("shard"), "id", "name", "x")


def _search(shards: DataFrame, dim: int, k: int, least: float, parts: int, degree: int, beam: int, exact: bool = False) -> DataFrame:
    """(a, b, cosine): up to k best neighbours b of each a in each shard, by graph or exactly."""
    def pack(shard, ids, names, raw):  # noqa: ANN001, ANN202
        # Of identical vectors the k + 1 smallest names are in the graph; the others' neighbours are the k smallest.
        run = np.cumsum(np.diff(shard, prepend=shard[0]) != 0)  # a row may stand in several shards of a pack
        _, same, n_same = np.unique(run * len(raw) + np.unique(np.array(raw, dtype=object), return_inverse=True)[1], return_inverse=True, return_counts=True)
        extra = None
        if n_same.max() > k + 1:
            name = np.array(names, dtype=object)
            order = np.lexsort((np.argsort(np.argsort(name, kind="stable"), kind="stable"), same))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) - np.searchsorted(same[order], same[order])
            lead, rest = order[place[order] < k], np.flatnonzero(place > k)
            j = lead[np.searchsorted(same[lead], same[rest])[:, None] + np.arange(k)].ravel()
            extra = (name[np.repeat(rest, k)], name[j])
            kept = np.flatnonzero(place <= k)
            shard, names, raw = shard[kept], name[kept].tolist(), [raw[i] for i in kept]
        v = _floats(raw, dim)
        at = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        n = np.diff(np.append(at, len(shard)))
        # Exact cosines decide the order; a few more than k, since single precision may swap ties.
        if exact:
            w, i, j = v.astype(np.float32), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, m in zip(at, n):
                for a in range(s, s + m if m > 1 else s, 1024):
                    q = np.arange(a, min(a + 1024, s + m))
                    c = w[q] @ w[s : s + m].T
                    c[np.arange(len(q)), q - s] = -2
                    near = np.argpartition(-c, min(k + 5, m - 1) - 1, axis=1)[:, : min(k + 5, m - 1)] + s
                    i.append(np.repeat(q, near.shape[1]))
                    j.append(near.ravel())
            i, j = np.concatenate(i), np.concatenate(j)
        else:
            g = Graph(v.astype(np.float32), np.repeat(at, n), np.repeat(n, n), degree, beam).build()
            rows = np.flatnonzero(np.repeat(n, n) > 1)
            got, _ = g.search(rows, beam + beam // 2)
            got = got[:, : k + 5]
            i, j = np.repeat(rows, got.shape[1]), got.ravel()
            i, j = i[j >= 0], j[j >= 0]
        c = np.concatenate([np.einsum("ij,ij->i", v[i[s : s + 65536]], v[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        ok = c >= least
        i, j, c = i[ok], j[ok], c[ok]
        name = np.array(names, dtype=object)
        order = np.lexsort((np.argsort(np.argsort(name, kind="stable"))[j] if len(j) else j, -np.round(c, 12), i))
        i, j, c = i[order], j[order], c[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        a, b, c = name[i[first]], name[j[first]], c[first]
        if extra is not None:
            a, b, c = np.append(a, extra[0]), np.append(b, extra[1]), np.append(c, np.ones(len(extra[0])))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c)], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        shard, ids = t["shard"].to_numpy(), t["id"].to_numpy()
        order = np.lexsort((ids, shard))
        first = np.append(True, (np.diff(shard[order]) != 0) | (np.diff(ids[order]) != 0))
        order = order[first]
        shard, ids = shard[order], ids[order]
        t = t.take(pa.array(order))
        at = np.append(np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)), len(shard))
        s = 0
        while s < len(at) - 1:  # whole shards, PACK_ROWS at a time
            e = max(s + 1, int(np.searchsorted(at, at[s] + PACK_ROWS, side="right")) - 1)
            part = t.slice(at[s], at[e] - at[s])
            yield pack(shard[at[s] : at[e]], ids[at[s] : at[e]], part["name"].to_pylist(), part["x"].to_pylist())
            s = e

    return shards.repartition(parts, "shard").mapInArrow(run, "a string, b string, cosine double")


def neighbours(records: DataFrame, idc: str, vector: str, k: int, least: float, dim: int = 64, degree: int = 12, beam: int = 16) -> DataFrame:
    """(a, b, cosine): the up to k most similar records b of each record a, cosine at least ``least``."""
    spark = records.sparkSession
    stage = Stage(spark, "neighbours")
    lab = stage.put(Labels(records, idc, vector, least, dim, stage=stage).labels(), "all-labels")
    n = F.count("*")
    cuts = F.when(n > SHARD_ROWS, F.ceil(n * 2 / SHARD_ROWS)).when(n > GRAPH_ROWS, 1).otherwise(0).cast("long")
    size = lab.groupBy("label").agg(cuts.alias("parts"))
    where = stage.put(lab.join(size, "label").select("id", "label", "parts"), "where")
    counts = {r["parts"] for r in where.select(F.least("parts", F.lit(2)).alias("parts")).distinct().collect()}
    at = _stored(records, idc, vector, dim).join(where, "id").select("id", "name", "x", "label", "parts")
    whole = lambda p: at.filter(F.col("parts") == p).select(F.col("label").alias("shard"), "id", "name", "x")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), where.count() // 20_000)
    found = _search(whole(0), dim, k, least, parts, degree, beam)
    if 1 in counts:
        found = found.unionByName(_search(whole(1), dim, k, least, parts, degree, beam, exact=True))
    if 2 not in counts:  # every record is in one shard
        return found
    found = found.unionByName(_search(_cut(at), dim, k, least, parts, degree, beam, exact=True))
    found = stage.put(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "found")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("cosine", 12)).alias("d"), "b", "cosine"))), 1, k)
    return found.groupBy("a").agg(best.alias("n")).select("a", F.explode("n").alias("n")).select("a", "n.b", "n.cosine")


def search(records: DataFrame, queries: DataFrame, idc: str, vector: str, k: int, dim: int = 64, shard_rows: int = 2048,
           degree: int = 16, beam: int = 32, probe: int = 48) -> DataFrame:
    """(a, b, cosine): the k most similar records b of each query a, however far, over all records.

    queries: (idc, vector), a stated set. Records are spread over blocks by a hash, blocks are cut
    into shards of ``shard_rows``, each with its graph; every query is searched in every shard by a
    beam of ``probe``, and the best k of all shards stay. Blocks of records and of queries meet
    once. A query's own name is no neighbour; equal cosines (to 1e-12) are ordered by name.
    """
    spark = records.sparkSession
    stage = Stage(spark, "search")
    rows = stage.put(_stored(records, idc, vector, dim).dropDuplicates(["id"]), "rows")
    blocks = max(1, -(-rows.count() // PACK_ROWS))
    q = _stored(queries, idc, vector, dim).dropDuplicates(["id"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(31)), F.lit(blocks)).cast("int"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())}
        if left.num_rows and right.num_rows:
            right = right.take(pa.array(np.argsort(right["id"].to_numpy(), kind="stable")))
            x, y = _floats(right["x"].to_pylist(), dim), _floats(left["x"].to_pylist(), dim)
            names, asked = (np.array(t["name"].to_pylist(), dtype=object) for t in (right, left))
            at = np.arange(0, len(x), shard_rows)
            n = np.diff(np.append(at, len(x)))
            g = Graph(x.astype(np.float32), np.repeat(at, n), np.repeat(n, n), degree, beam).build()
            q32, ids = y.astype(np.float32), []
            for s in at:
                ids.append(g.find(q32, s, probe)[0][:, : k + 5])
            ids = np.concatenate(ids, 1)
            i, j = np.repeat(np.arange(len(y)), ids.shape[1]), ids.ravel()
            i, j = i[j >= 0], j[j >= 0]
            keep = asked[i] != names[j]
            i, j = i[keep], j[keep]
            c = np.concatenate([np.einsum("ij,ij->i", y[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            order = np.lexsort((np.argsort(np.argsort(names, kind="stable"))[j], -np.round(c, 12), i))
            i, j, c = i[order], j[order], c[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out = {"a": pa.array(asked[i[first]], pa.string()), "b": pa.array(names[j[first]], pa.string()), "cosine": pa.array(c[first])}
        return pa.table(out)

    found = q.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(run, "a string, b string, cosine double")
    w = W.partitionBy("a").orderBy(F.desc(F.round("cosine", 12)), "b")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def pairs_of(found: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b): one row per unordered pair."""
    return found.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")).distinct()
