"""Grids over unit vectors, and the nearest pairs that share their cells.

A grid rotates the unit vectors at random and quantises them to the signed coordinate that is
largest (a cell of the cross-polytope, 128 cells in 64 dimensions). When the collection grows,
further rotations cut to few coordinates refine every cell, as many as keep a few hundred rows in
a cell on average. A vector stands in two cells of a grid, those of its two largest coordinates:
two vectors with a cosine of 0.82 share one of them with a probability of 0.67 before refinement
and 0.37 at 1 024 cells (measured on random pairs), and grids are independent.

Vectors with the same direction are one row from the start. Vectors move as 16-bit integers (unit
vectors times 32767: a cosine is exact to about 2e-5); what lies that close to a decision is
decided on the stored vectors in double precision.

Cells are counted over all rows first. A cell that is too full for one task is refined by what
its rows differ in: their differences from the cell's mean are rotated and quantised like the
vectors themselves, to as many cells as the count asks for. A refined cell that is still too full
is cut into parts by id, and each pair of parts is a block, so every two of its rows are compared;
they move once for each other part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.session import Stage, ship

SCALE = 32767.0
CELL_ROWS = 16384  # rows of a cell that one task takes
BAND = 1e-4  # half width of the band around a threshold that is decided in double precision


def rotations(dim: int, grid: int, stages: int) -> list[np.ndarray]:
    """The rotations of one grid: the first one and one for each refinement."""
    rng = np.random.RandomState(5 + 7919 * grid)
    return [np.linalg.qr(rng.randn(dim, dim))[0].astype(np.float32) for _ in range(stages)]


def refinement(rows: int, dim: int, per_cell: int = 400) -> list[int]:
    """Coordinates of each further rotation; each is a power of two and gives twice as many cells."""
    need, out = rows / (2 * dim * per_cell), []
    while need > 2:
        out.append(min(dim, 1 << int(np.ceil(np.log2(need / 2)))))
        need /= 2 * out[-1]
    return out


def _largest(y: np.ndarray, n: int = 1) -> np.ndarray:
    """Signed places of the n largest coordinates of each row."""
    a = np.abs(y)
    at = np.argpartition(-a, n, axis=1)[:, :n] if n < y.shape[1] else np.tile(np.arange(n), (len(y), 1))
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(a, at, 1), axis=1, kind="stable"), 1)
    return at.astype(np.int64) * 2 + (np.take_along_axis(y, at, 1) > 0)


def codes(u: np.ndarray, rots: list[np.ndarray], fine: list[int], probes: int = 1) -> np.ndarray:
    """Cells of each row in one grid, a column for each probe."""
    u = u.astype(np.float32)
    c = _largest(u @ rots[0], probes)
    for r, f in zip(rots[1:], fine):
        c = c * (2 * f) + _largest(u @ r[:, :f])
    return c


def good(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors (double) of the good vectors of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(col.offsets.to_numpy())
    ok = np.flatnonzero((n == dim) & np.asarray(col.is_valid()))
    if not len(ok):
        return ok, np.zeros((0, dim))
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = col.offsets.to_numpy()[:-1][ok]
    v = flat[at[:, None] + np.arange(dim)]
    v[~np.isfinite(v).all(1)] = 0.0  # null elements come as NaN
    v /= np.maximum(np.abs(v).max(1), 1e-300)[:, None]
    norm = np.sqrt((v * v).sum(1))
    fine = norm > 0
    return ok[fine], v[fine] / norm[fine, None]


def pack(u: np.ndarray) -> pa.Array:
    q = np.rint(u * SCALE).astype(np.int16)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * q.shape[1]), len(q), [None, pa.py_buffer(q.tobytes())]).cast(pa.binary())


def unpack(col: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in float32 of packed ones."""
    if not len(col):
        return np.zeros((0, dim), np.float32)
    v = np.frombuffer(b"".join(col.to_pylist()), np.int16).reshape(-1, dim).astype(np.float32)
    return v / np.sqrt((v * v).sum(1))[:, None]


def distinct_vectors(records: DataFrame, idc: str, vector: str, dim: int) -> DataFrame:
    """(id, h, v): good vectors, packed; h is a hash of the direction (to 2^-23 a coordinate)."""
    ship(records.sparkSession)
    salt = np.random.RandomState(3).randint(1, 1 << 62, dim).astype(np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, u = good(b.column(1), dim)
            if len(ok):
                q = np.rint(u * (1 << 23)).astype(np.int64).view(np.uint64) * salt
                q = (q ^ (q >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
                h = (q ^ (q >> np.uint64(29))).sum(1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(h.view(np.int64)), pack(u)], names=["id", "h", "v"])

    src = records.filter(F.col(idc).isNotNull() & (F.size(vector) == dim)).select(F.xxhash64(idc).alias("id"), F.col(vector))
    return src.mapInArrow(run, "id long, h long, v binary")


def gridded(vectors: DataFrame, dim: int, grids: list[int], rows: int, probes: int = 2) -> DataFrame:
    """(cell, block, id, v): each row of vectors (id, v) in ``probes`` cells of each grid.

    block is 0 unless a refined cell is still too full; then its rows are cut into parts by id and
    stand once in the block of each pair of parts.
    """
    fine = refinement(rows * probes, dim)
    rots = [rotations(dim, g, len(fine) + 6) for g in grids]
    ship(vectors.sparkSession)
    cells = int(2 * dim * np.prod([2 * f for f in fine], dtype=np.int64))

    def coarse(u: np.ndarray) -> np.ndarray:
        return np.concatenate([codes(u, r, fine, probes) + t * cells for t, r in enumerate(rots)], 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.unique(coarse(unpack(b.column(0), dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["cell", "n"])

    full = {}
    if rows > CELL_ROWS:
        n = vectors.select("v").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        full = {r["cell"]: r["n"] for r in n.filter(F.col("n") > CELL_ROWS).collect()}  # at most rows * probes * grids / CELL_ROWS cells
    known = np.array(sorted(full), np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(known), dim))
        for b in batches:
            u = unpack(b.column(0), dim)
            for c in coarse(u).T:
                at = np.flatnonzero(np.isin(c, known))
                np.add.at(total, np.searchsorted(known, c[at]), u[at])
        yield pa.RecordBatch.from_arrays([pa.array(known), *(pa.array(x) for x in total.T)], names=["cell", *(f"x{i}" for i in range(dim))])

    mean = np.zeros((0, dim))
    if full:
        got = vectors.select("v").mapInArrow(sums, "cell long, " + ", ".join(f"x{i} double" for i in range(dim))).groupBy("cell").agg(
            *[F.sum(f"x{i}").alias(f"x{i}") for i in range(dim)]).orderBy("cell").toArrow()
        mean = np.stack([got[f"x{i}"].to_numpy() for i in range(dim)], 1) / np.array([[full[c]] for c in known])
    finer = {c: refinement(2 * n, dim) for c, n in full.items()}

    def refined(u: np.ndarray, cell: np.ndarray, t: int) -> np.ndarray:
        """Numbers of refined cells (from 1, 0: not refined) of the rows of grid t."""
        sub = np.zeros(len(cell), np.int64)
        if len(known):
            for c in np.intersect1d(cell, known):
                own = np.flatnonzero(cell == c)
                sub[own] = 1 + codes(u[own] - mean[np.searchsorted(known, c)], rots[t][len(fine) + 1 :], finer[c])[:, 0]
        return sub

    def recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unpack(b.column(0), dim)
            for t in range(len(rots)):
                for c in coarse(u)[:, t * probes : (t + 1) * probes].T:
                    s = refined(u, c, t)
                    pair, n = np.unique(np.stack([c[s > 0], s[s > 0]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(n)], names=["cell", "sub", "n"])

    parts: dict[tuple[int, int], int] = {}
    if full:
        n = vectors.select("v").mapInArrow(recounted, "cell long, sub long, n long").groupBy("cell", "sub").agg(F.sum("n").alias("n"))
        parts = {(r["cell"], r["sub"]): -(-2 * r["n"] // CELL_ROWS) for r in n.filter(F.col("n") > CELL_ROWS).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(s, 1 << 13) for b in batches for s in range(0, b.num_rows, 1 << 13)):
            u, ids = unpack(b.column(1), dim), b.column(0)
            mixed = (ids.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t, r in enumerate(rots):
                for c in (codes(u, r, fine, probes) + t * cells).T:
                    sub = refined(u, c, t)
                    cell, at, block = [c], [np.arange(len(c))], [sub << np.int64(24)]
                    for i in np.flatnonzero(sub) if parts else ():
                        n = parts.get((c[i], sub[i]))
                        if n:  # the block of each pair of parts
                            own = int(mixed[i] % np.uint64(n))
                            both = [min(own, j) * n + max(own, j) for j in range(n) if j != own]
                            block[0][i] = -1
                            at.append(np.full(n - 1, i))
                            cell.append(np.full(n - 1, c[i]))
                            block.append((sub[i] << np.int64(24)) + 1 + np.array(both, np.int64))
                    cell, at, block = (np.concatenate(x) for x in (cell, at, block))
                    for s in range(0, len(at), 1 << 16):
                        use = np.flatnonzero(block[s : s + (1 << 16)] >= 0) + s
                        x = pa.array(at[use])
                        yield pa.RecordBatch.from_arrays([pa.array(cell[use]), pa.array(block[use]), ids.take(x), b.column(1).take(x)], names=["cell", "block", "id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "cell long, block long, id long, v binary")


def cosines(pairs: DataFrame, records: DataFrame, idc: str, vector: str, dim: int) -> DataFrame:
    """(a, b, cosine) of pairs of hashed ids, in double precision from the stored vectors."""
    ship(pairs.sparkSession)
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vec = records.filter(F.size(vector) == dim).select(F.xxhash64(idc).alias("id"), F.col(vector).alias("x")).join(
        need, "id", "left_semi").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, x = good(b.column(2), dim)
            q, y = good(b.column(3), dim)
            both = np.intersect1d(p, q)
            w = np.einsum("ij,ij->i", x[np.searchsorted(p, both)], y[np.searchsorted(q, both)])
            at = pa.array(both)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(w)], names=["a", "b", "cosine"])

    j = pairs.join(vec.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(
        vec.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    return j.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long, cosine double")


def blocks_of(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, ids, unit vectors) of each block of two or more rows of a partition; repeated ids count once."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    cell, block, ids = (t[c].to_numpy() for c in ("cell", "block", "id"))
    order = np.lexsort((ids, block, cell))
    cell, block, ids = cell[order], block[order], ids[order]
    group = (np.diff(cell, prepend=cell[0] - 1) != 0) | (np.diff(block, prepend=block[0]) != 0)
    first = group | (np.diff(ids, prepend=ids[0]) != 0)
    cell, ids, group = cell[first], ids[first], group[first]
    vec = t["v"].take(pa.array(order[first]))
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    at = np.flatnonzero(group)
    for s, e in zip(at, np.append(at[1:], len(cell))):
        if e - s > 1:
            yield int(cell[s]), ids[s:e], unpack(vec.slice(s, e - s), dim)


def nearest_pairs(records: DataFrame, idc: str, vector: str, k: int, least: float, dim: int = 64, grids: int = 6) -> DataFrame:
    """(a, b, cosine): of each record a the up to k most similar others b with a cosine over ``least``.

    Cosines are rounded to nine places; ties fall to the greater name. Of records with the same
    direction only the k + 1 greatest names are in the grids.
    A pair at a cosine of 0.9 is missed with a probability of 3e-5 before refinement, 2e-2 at 1 024 cells; closer pairs less.
    """
    spark = records.sparkSession
    stage = Stage(spark, "nearest")
    names = records.filter(F.col(idc).isNotNull()).select(F.xxhash64(idc).alias("id"), F.col(idc).alias("name")).distinct()
    every = stage.put(distinct_vectors(records, idc, vector, dim).dropDuplicates(["id"]).join(names, "id"), "vectors")
    r = F.row_number().over(W.partitionBy("h").orderBy(F.desc("name")))
    lead = stage.put(every.select("h", "id", "name").withColumn("r", r).filter(F.col("r") <= k + 1), "leads")
    rows = every.join(lead.select("id"), "id", "left_semi").select("id", "v")
    n = lead.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * grids * 2 // 150_000)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x in blocks_of(batches, dim):
            step = int(max(64, min(1024, (1 << 23) // len(x))))
            for a in range(0, len(x), step):
                s = x[a : a + step] @ x.T
                s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
                low = np.full(len(s), least - BAND, np.float32)
                if len(ids) > k:  # all that may be among the k best
                    low = np.maximum(low, -np.partition(-s, k - 1, axis=1)[:, k - 1] - 2 * BAND)
                i, j = np.nonzero(s >= low[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + a]), pa.array(ids[j])], names=["a", "b"])

    cells = gridded(stage.put(rows, "rows"), dim, list(range(grids)), n)
    pairs = stage.put(cells.repartition(parts, "cell", "block").mapInArrow(best, "a long, b long").distinct(), "pairs")
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    c = stage.put(cosines(one, records, idc, vector, dim).withColumn("cosine", F.round(F.least("cosine", F.lit(1.0)), 9)).filter(F.col("cosine") > least), "cosines")
    of = lambda s: names.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}"))
    c = c.join(of("a"), "a").join(of("b"), "b")
    both = c.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "cosine").unionByName(c.select(F.col("name_b").alias("a"), F.col("name_a").alias("b"), "cosine"))
    top = W.partitionBy("a").orderBy(F.desc("cosine"), F.desc("b"))
    found = stage.put(both.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k).drop("_r"), "found")
    # Directions with more names than the grids hold: the others have the neighbours of the last name in the grids.
    last = lead.filter(F.col("r") == k + 1).select("h", F.col("name").alias("last"))
    rest = every.select("h", "id", "name").join(last, "h").join(lead.select("id"), "id", "left_anti")
    return found.unionByName(rest.join(found.withColumnRenamed("a", "last"), "last").select(F.col("name").alias("a"), "b", "cosine"))
