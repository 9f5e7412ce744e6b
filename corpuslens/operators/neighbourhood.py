"""Exact cosines inside clusters, blocked k nearest neighbours, calibration, density clusters."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions import scores, vectors
from corpuslens.operators.components import components
from corpuslens.operators.groups import dense_ids
from corpuslens.session import ship

CLUSTER_CAP = 2000
BLOCK_ROWS = 20_000


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    v = np.array(col.to_pylist(), np.float64)
    n = np.sqrt((v * v).sum(1))
    return v / np.where(n == 0, 1.0, n)[:, None]


def capped(rows: DataFrame, cluster: str, idc: str, cap: int = CLUSTER_CAP) -> DataFrame:
    """At most cap members of each cluster, chosen by a hash of the id (the scanner's memory rule)."""
    w = W.partitionBy(cluster).orderBy(F.md5(idc), idc)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).drop("_k")


def cluster_cosines(rows: DataFrame, least: float = -2.0, top: int | None = None, cap: int = CLUSTER_CAP) -> DataFrame:
    """(cluster_id, a, b, cosine), a != b, of rows (cluster_id, chunk_id, embedding).

    For the candidates of the pair model: one matrix product a cluster, and clusters are capped
    for it (the scanner's own rule, see ``capped``), so a task's memory is bounded. top: only the
    best of each a (ties: the greater id).
    """
    ship(rows.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        ids = np.array(t["chunk_id"].to_pylist(), dtype=object)
        o = np.argsort(ids)
        x = _matrix(t["embedding"])[o]
        ids = ids[o]
        s = np.round(np.clip(x @ x.T, -1, 1), 9)
        np.fill_diagonal(s, -9)
        if top is None:
            i, j = np.nonzero(s > least)
        else:
            k = min(top, len(ids) - 1)
            order = np.argsort(-s[:, ::-1], axis=1, kind="stable")[:, :k]
            j = (len(ids) - 1 - order).ravel()
            i = np.repeat(np.arange(len(ids)), k)
            ok = s[i, j] > least
            i, j = i[ok], j[ok]
        c = t["cluster_id"][0].as_py()
        return pa.table({"cluster_id": pa.array([c] * len(i), pa.int32()), "a": pa.array(ids[i], pa.string()), "b": pa.array(ids[j], pa.string()), "cosine": s[i, j]})

    return capped(rows, "cluster_id", "chunk_id", cap).select("cluster_id", "chunk_id", "embedding").groupBy("cluster_id").applyInArrow(
        run, "cluster_id int, a string, b string, cosine double")


def blocked_knn(queries: DataFrame, data: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(q, b, cosine, rank): exact k nearest rows of data for each query, itself left out.

    Both sides are (id BIGINT, v). The data is cut into blocks of about BLOCK_ROWS rows, every query meets every block once
    (one matrix product a block), and the k best of all blocks are kept.
    """
    ship(queries.sparkSession)
    blocks = blocks or max(1, -(-data.count() // BLOCK_ROWS))
    d = data.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    q = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())}
        if left.num_rows and right.num_rows:
            qi, di = left["id"].to_numpy(), right["id"].to_numpy()
            o = np.argsort(di)
            di, x, y = di[o], _matrix(left["v"]), _matrix(right["v"])[o]
            s = np.round(np.clip(x @ y.T, -1, 1), 9)
            s[qi[:, None] == di[None, :]] = -9
            n = min(k, len(di))
            j = np.argsort(-s, axis=1, kind="stable")[:, :n]
            c = np.take_along_axis(s, j, 1).ravel()
            ok = c > -5
            out = {"q": pa.array(np.repeat(qi, n)[ok]), "b": pa.array(di[j.ravel()][ok]), "cosine": pa.array(c[ok])}
        return pa.table(out)

    found = q.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(run, "q long, b long, cosine double")
    w = W.partitionBy("q").orderBy(F.desc("cosine"), "b")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def calibration_sample(embeddings: DataFrame, idc: str, v: str, sample: int = 2000, pairs: int = 10_000, k: int = 10) -> DataFrame:
    """(kind, cosine): baseline of hash-chosen pairs and k-neighbour cosines of a sample.

    The sample size is the operator's parameter (2 000 vectors and 10 000 pairs); the choice is by
    md5, of pairs by a linear hash of their places in the order of ids, so it is the same on every
    run and in SQL.
    """
    ship(embeddings.sparkSession)
    s = embeddings.select(F.col(idc).alias("id"), F.col(v).alias("v")).orderBy(F.md5(F.col(idc).cast("string")), idc).limit(sample)

    def run(t: pa.Table) -> pa.Table:
        ids = np.array(t["id"].to_pylist(), dtype=object)
        o = np.argsort(ids)
        ids, x = ids[o], _matrix(t["v"])[o]
        c = np.round(np.clip(x @ x.T, -1, 1), 9)
        i, j = np.triu_indices(len(ids), 1)
        if len(i) > pairs:
            h = ((i.astype(np.int64) * 48271 + j * 16807) % 2147483647) * 69621 % 2147483647
            keep = np.lexsort((j, i, h))[:pairs]
            i, j = i[keep], j[keep]
        base = c[i, j]
        np.fill_diagonal(c, -9)
        near = -np.sort(-c, axis=1)[:, : min(k, len(ids) - 1)].ravel()
        return pa.table({"kind": ["baseline"] * len(base) + ["neighbour"] * len(near), "cosine": np.concatenate([base, near])})

    return s.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "kind string, cosine double")


def sample_hash(rows: DataFrame, idc: str, sample: int = 2000) -> DataFrame:
    """One row: a hash of the sample's ids that doesn't depend on their order."""
    s = rows.select(F.col(idc).cast("string").alias("id")).orderBy(F.md5("id"), "id").limit(sample)
    return s.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ""), 256).alias("sample_hash"))


def json_of(text: str | None) -> dict:
    return json.loads(text) if text else {}


def percentiles(sample: DataFrame) -> DataFrame:
    p = F.expr("percentile(cosine, array(0.5, 0.95, 0.99))")
    return sample.groupBy("kind").agg(F.count("*").alias("n"), p.alias("p")).select(
        "kind", "n", *[F.col("p")[i].alias(x) for i, x in enumerate(("p50", "p95", "p99"))])


def threshold_row(sample: DataFrame, dim: int) -> DataFrame:
    """One row of thresholds; degenerate distributions give the model defaults of the dimension."""
    q = lambda kind, p: F.expr(f"percentile(CASE WHEN kind = '{kind}' THEN cosine END, {p})")
    r = sample.agg(q("baseline", 0.95).alias("b95"), q("neighbour", 0.5).alias("n50"), q("neighbour", 0.99).alias("n99"))
    dd, cc, nn = scores.thresholds(F.col("b95"), F.col("n50"), F.col("n99"))
    ok = F.coalesce((F.col("b95") < cc) & (cc < dd) & (dd < 1.0), F.lit(False))
    d0 = model_default(dim)
    names = ("dedup_threshold", "contradiction_threshold", "cluster_min_density")
    return r.select(*[F.when(ok, c).otherwise(F.lit(v)).alias(n) for c, v, n in zip((dd, cc, nn), d0, names)])


def model_default(dim: int | None) -> tuple[float, float, float]:
    if dim is None:
        return scores.GENERIC_DEFAULTS
    return scores.MODEL_DEFAULTS[min(scores.MODEL_DEFAULTS, key=lambda x: (abs(x - dim), x))]


def density_clusters(near: DataFrame, core: int = 3, min_size: int = 5) -> DataFrame:
    """(chunk_id, cluster_key, n): mutual neighbours between core rows, as components of min_size or more.

    near: (a, b, cosine), the neighbours b of each a over the density cut. Rows in no component
    are noise.
    """
    mutual = near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).select("a", "b")
    cores = mutual.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= core).select("a")
    e = mutual.join(cores, "a").join(cores.select(F.col("a").alias("b")), "b").filter("a < b")
    lab = components(e)
    n = lab.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return lab.join(n, "label").select(F.col("id").alias("chunk_id"), F.col("label").alias("cluster_key"), "n")


def assigned(clusters: DataFrame) -> DataFrame:
    """(chunk_id, cluster_id): clusters (chunk_id, cluster_key) numbered in the order of their keys."""
    ids = dense_ids(clusters.select(F.col("cluster_key").alias("label")).distinct())
    return clusters.join(ids, clusters["cluster_key"] == ids["label"]).select("chunk_id", F.col("group_id").alias("cluster_id"))


def silhouette(rows: DataFrame, sample: int = 2000, dim: int = 64) -> DataFrame:
    """One row (n_clusters, n_clustered, silhouette) of rows (chunk_id, cluster_id, embedding).

    Distances are squared Euclidean between unit vectors: the mean distance of a row to a cluster
    is 2 - 2 times its product with the cluster's mean, so no pair of rows is needed. The score is
    the mean over ``sample`` rows (the documented bound, chosen by md5) against all clusters; null
    with fewer than two clusters.
    """
    ship(rows.sparkSession)
    u = rows.select("chunk_id", "cluster_id", vectors.unit(F.col("embedding")).alias("u"))
    c = centroids(rows.select("cluster_id", "embedding"), dim)
    s = u.orderBy(F.md5("chunk_id"), "chunk_id").limit(sample)
    some = F.broadcast(s.select(F.lit(1).alias("_1"), F.col("cluster_id").alias("own"), "chunk_id", "u"))  # at most ``sample`` rows
    d = c.withColumn("_1", F.lit(1)).join(some, "_1").select(
        "chunk_id", F.col("cluster_id") == F.col("own"), "n_chunks", (2 - 2 * vectors.dot(F.col("u"), F.col("centroid"))).alias("d")).toDF("chunk_id", "mine", "n", "d")
    # The mean distance to the own cluster leaves the row itself (distance 0) out.
    g = d.groupBy("chunk_id").agg(F.max(F.when(F.col("mine"), F.when(F.col("n") > 1, F.col("d") * F.col("n") / (F.col("n") - 1)))).alias("a"),
                                  F.min(F.when(~F.col("mine"), F.col("d"))).alias("b"))
    top = F.greatest("a", "b")
    one = F.when(F.col("a").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    score = g.filter("b is not null").agg(F.avg(one).alias("silhouette")).withColumn("_1", F.lit(1))
    n = c.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_clustered")).withColumn("_1", F.lit(1))
    return n.join(F.broadcast(score), "_1").select("n_clusters", "n_clustered", "silhouette")  # one row each


def centroids(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(cluster_id, n_chunks, centroid): mean of the unit vectors, one partially aggregated sum for each place."""
    u = rows.select("cluster_id", vectors.unit(F.col("embedding")).alias("u"))
    m = u.groupBy("cluster_id").agg(F.count("*").alias("n_chunks"), *[F.avg(F.col("u")[i]).alias(f"x{i}") for i in range(dim)])
    return m.select("cluster_id", "n_chunks", F.array(*[f"x{i}" for i in range(dim)]).alias("centroid"))


def drift(embedding: Column, centroid: Column) -> Column:
    """1 - cosine with the unit centroid, 0 without one."""
    cos = vectors.dot(vectors.unit(embedding), vectors.unit(centroid))
    return F.when(centroid.isNull() | embedding.isNull(), 0.0).otherwise(1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))


def hdbscan(x: np.ndarray, min_size: int = 5, min_samples: int = 3) -> np.ndarray:
    """Labels (-1: noise) by the published hierarchy: mutual reachability, spanning tree, condensed
    tree, excess of mass. For one block of rows; quadratic in it."""
    n = len(x)
    lab = np.full(n, -1)
    if n < max(2, min_size):
        return lab
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    core = np.sort(d, 1)[:, min(min_samples, n - 1)]
    m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, frm, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, cur = [], 0
    for _ in range(n - 1):
        done[cur] = True
        closer = ~done & (m[cur] < best)
        best[closer], frm[closer] = m[cur][closer], cur
        cur = int(np.where(done, np.inf, best).argmin())
        edges.append((best[cur], frm[cur], cur))
    edges.sort()
    parent, size, left, right, dist = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}, {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for s, (w, a, b) in enumerate(edges):
        p, q, new = find(a), find(b), n + s
        parent[p] = parent[q] = new
        left[new], right[new], dist[new], size[new] = p, q, w, size[p] + size[q]

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += [left[j], right[j]]
        return out

    birth, stability, kids, node = {0: 0.0}, {0: 0.0}, {0: []}, {0: 2 * n - 2}
    todo, count = [(2 * n - 2, 0)], 1
    while todo:
        i, c = todo.pop()
        if i < n:
            continue
        lam = 1 / dist[i] if dist[i] > 0 else 1e12
        a, b = left[i], right[i]
        big = [s for s in (a, b) if size[s] >= min_size]
        stability[c] += (size[a] + size[b] - (size[big[0]] if len(big) == 1 else 0)) * (lam - birth[c])
        if len(big) == 2:
            for s in big:
                birth[count], stability[count], kids[count], node[count] = lam, 0.0, [], s
                kids[c].append(count)
                todo.append((s, count))
                count += 1
        elif big:
            todo.append((big[0], c))
    chosen = {}
    for c in range(count - 1, -1, -1):
        below = sum(stability[k] for k in kids[c])
        if c and (not kids[c] or stability[c] >= below):
            chosen[c] = True
        else:
            stability[c] = max(stability[c], below) if c else below
    if count == 1:
        return lab
    out, todo = [], list(kids[0])
    while todo:
        c = todo.pop()
        if chosen.get(c):
            out.append(c)
        else:
            todo += kids[c]
    for k, c in enumerate(sorted(out, key=lambda c: min(leaves(node[c])))):
        lab[leaves(node[c])] = k
    return lab


def block_hdbscan(rows: DataFrame, min_size: int = 5, cap: int = CLUSTER_CAP) -> DataFrame:
    """(block, chunk_id, label): the hierarchy of each block of rows (block, chunk_id, embedding).

    The hierarchy is quadratic, so blocks over ``cap`` rows, which are density clusters already,
    stay one cluster (label 0) instead.
    """
    ship(rows.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        ids = np.array(t["chunk_id"].to_pylist(), dtype=object)
        o = np.argsort(ids)
        lab = hdbscan(_matrix(t["embedding"])[o], min_size)
        return pa.table({"block": pa.array([t["block"][0].as_py()] * len(o), pa.string()), "chunk_id": pa.array(ids[o], pa.string()), "label": pa.array(lab, pa.int32())})

    rows = rows.select("block", "chunk_id", "embedding")
    size = rows.groupBy("block").agg((F.count("*") > cap).alias("large"))
    rows = rows.join(size, "block")
    small = rows.filter("not large").drop("large").groupBy("block").applyInArrow(run, "block string, chunk_id string, label int")
    return small.unionByName(rows.filter("large").select("block", "chunk_id", F.lit(0).cast("int").alias("label")))
