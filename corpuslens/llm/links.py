"""The links inside the cells of grids (``operators.grids``): fragments of similar vectors.

Links within BAND of the threshold are decided on the stored vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.grids import BAND, blocks_of, cosines
from corpuslens.session import ship


def _dense(mask: np.ndarray, lr: np.ndarray, lc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label that rows and columns of a dense link mask reach."""
    top = np.iinfo(np.int64).max
    while True:
        c = np.minimum(lc, np.where(mask, lr[:, None], top).min(0))
        r = np.minimum(lr, np.where(mask, c[None, :], top).min(1))
        if (c == lc).all() and (r == lr).all():
            return r, c
        lr, lc = r, c


def fragments(x: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Component label of each row of one block, and the (i, j) within BAND of the cut that matter.

    Links of a dense block are never listed: labels pass through its mask.
    """
    n = len(x)
    lab = np.arange(n)
    block = int(max(64, min(1024, (1 << 23) // n)))
    edges, close = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for a in range(0, n, block):
        s = x[a : a + block] @ x[a:].T
        mask = s >= cut - BAND
        if np.count_nonzero(mask) > 32 * (n - a):
            sure = s >= cut + BAND
            r, c = _dense(sure, np.arange(a, min(a + block, n)), np.arange(a, n))
            edges.append(np.stack([np.append(np.arange(a, a + len(r)), np.arange(a, n)), np.append(r, c)]))
            i, j = np.nonzero(mask & ~sure)
            close.append(np.stack([i + a, j + a]))
            continue
        i, j = np.nonzero(mask)
        i, j, w = i[j > i], j[j > i], s[i[j > i], j[j > i]]
        sure = w >= cut + BAND
        edges.append(np.stack([i[sure] + a, j[sure] + a]))
        close.append(np.stack([i[~sure] + a, j[~sure] + a]))
    ei, ej = np.concatenate(edges, 1)
    while len(ei):
        new = lab.copy()
        np.minimum.at(new, ei, lab[ej])
        np.minimum.at(new, ej, lab[ei])
        new = np.minimum(new, new[new])
        if (new == lab).all():
            break
        lab = new
    near = np.concatenate(close, 1)
    return lab, near[:, lab[near[0]] != lab[near[1]]]


def cell_links(cells: DataFrame, dim: int, cut: float, parts: int) -> DataFrame:
    """(cell, a, b, sure): star links of each block's components (a: one row of it) and doubtful single links."""
    ship(cells.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, own, x in blocks_of(batches, dim):
            n = len(own)
            lab, near = fragments(x, cut)
            inside = np.flatnonzero(np.bincount(lab, minlength=n)[lab] > 1)
            a = np.concatenate([own[lab[inside]], own[near[0]]])
            b = np.concatenate([own[inside], own[near[1]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), cell)), pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < len(inside))], names=["cell", "a", "b", "sure"])

    return cells.repartition(parts, "cell", "block").mapInArrow(run, "cell long, a long, b long, sure boolean")


def exact_links(doubt: DataFrame, records: DataFrame, idc: str, vector: str, dim: int, cut: float) -> DataFrame:
    """The doubtful links (a, b) whose stored vectors have a cosine of at least the cut."""
    return cosines(doubt, records, idc, vector, dim).filter(F.col("cosine") >= cut).select("a", "b")
