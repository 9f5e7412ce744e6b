"""A robust-pruned directed graph over packed shards of unit vectors, in numpy.

All rows of a pack are handled at once; a shard is a run of consecutive rows, and no edge leaves
its shard. Distances are those between unit vectors, so their squares are 2 - 2 cos.
"""

from __future__ import annotations

import numpy as np


def _dots(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Cosines of each query row with the rows ids (-1: none, -2 as cosine)."""
    d = np.einsum("brd,bd->br", x[ids], q, optimize=False)
    d[ids < 0] = -2.0
    return d


class Graph:
    def __init__(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, degree: int = 12, beam: int = 16, alpha: float = 1.2, seed: int = 3):
        """x: unit rows; start, size: first row and length of each row's shard."""
        self.x, self.start, self.size = x, start, size
        self.degree, self.beam, self.alpha2 = degree, beam, alpha * alpha
        n = len(x)
        local = np.arange(n) - start
        rng = np.random.RandomState(seed)
        # Shards up to degree + 1 rows: all others. Larger ones: random steps around a ring.
        off = np.arange(1, degree + 1)
        big = size > degree + 1
        span = rng.randint(1, 1 << 30, (n, degree))
        step = np.where(big[:, None], 1 + (off - 1 + (span % np.maximum(1, (size[:, None] - 1) // degree)) * degree) % np.maximum(1, size[:, None] - 1), off)
        self.near = np.where((off < size[:, None]), start[:, None] + (local[:, None] + step) % size[:, None], -1)
        order = np.sort(self.near, 1)
        self.near = np.where(np.diff(order, axis=1, prepend=-9) == 0, -1, order)
        self.big = np.flatnonzero(big)
        # Entry: the row nearest to the shard's mean.
        first = np.flatnonzero(local == 0)
        mean = np.add.reduceat(x, first, axis=0)
        fit = np.einsum("ij,ij->i", x, np.repeat(mean, size[first], axis=0))
        o = np.lexsort((-fit, start))
        self.entry = np.repeat(o[first], size[first])

    def search(self, rows: np.ndarray, beam: int, batch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of each row from its shard's entry: (ids, cosines), best first, itself left out."""
        ids, cos = np.full((len(rows), beam), -1), np.full((len(rows), beam), -2.0, np.float32)
        for a in range(0, len(rows), batch):
            ids[a : a + batch], cos[a : a + batch] = self._beam(rows[a : a + batch], beam)
        return ids, cos

    def find(self, q: np.ndarray, shard: int, beam: int, batch: int = 4096, starts: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of vectors that need not be rows, in the shard that begins at row ``shard``, from several of its rows."""
        ids, cos = np.full((len(q), beam), -1), np.full((len(q), beam), -2.0, np.float32)
        n = int(self.size[shard])
        first = np.unique(np.append(self.entry[shard], shard + np.arange(min(starts, n)) * n // min(starts, n)))[:beam]
        for a in range(0, len(q), batch):
            v = q[a : a + batch]
            i, c = np.full((len(v), beam), -1), np.full((len(v), beam), -2.0, np.float32)
            i[:, : len(first)], c[:, : len(first)] = first, v @ self.x[first].T
            i, c = self._walk(v, i, c)
            o = np.argsort(-c, axis=1, kind="stable")
            ids[a : a + batch], cos[a : a + batch] = np.take_along_axis(i, o, 1), np.take_along_axis(c, o, 1)
        return ids, cos

    def _beam(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, x = len(rows), self.x
        # The row itself is expanded first as well: its own edges lead to its surroundings.
        q = x[rows]
        ids, cos = np.full((n, beam), -1), np.full((n, beam), -2.0, np.float32)
        ids[:, 0] = rows
        cos[:, 0] = 2.0
        e = self.entry[rows]
        other = e != rows
        ids[other, 1] = e[other]
        cos[other, 1] = np.einsum("ij,ij->i", x[e[other]], q[other])
        out_i, out_c = self._walk(q, ids, cos)
        out_c[out_i == rows[:, None]] = -2.0
        out_i[out_i == rows[:, None]] = -1
        o = np.argsort(-out_c, axis=1, kind="stable")
        return np.take_along_axis(out_i, o, 1), np.take_along_axis(out_c, o, 1)

    def _walk(self, q: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expands the nearest row not yet expanded until each beam has none; (ids, cosines) in no order."""
        n, beam, x = *ids.shape, self.x
        out_i, out_c, done = ids.copy(), cos.copy(), np.zeros((n, beam), bool)
        live = np.arange(n)
        for _ in range(16 * beam):  # equal cosines may push one another out for ever
            if not len(live):
                break
            best = np.where(done | (ids < 0), -3.0, cos).argmax(1)
            r = np.arange(len(live))
            go = ~done[r, best] & (ids[r, best] >= 0)
            if not go.all():
                stop = ~go
                out_i[live[stop]], out_c[live[stop]] = ids[stop], cos[stop]
                live, q, ids, cos, done, best = live[go], q[go], ids[go], cos[go], done[go], best[go]
                if not len(live):
                    break
                r = np.arange(len(live))
            done[r, best] = True
            new = self.near[ids[r, best]]
            new = np.where((new[:, :, None] == ids[:, None, :]).any(2), -1, new)
            c = np.concatenate([cos, _dots(x, q, new)], 1)
            top = np.argpartition(-c, beam - 1, axis=1)[:, :beam]
            ids = np.take_along_axis(np.concatenate([ids, new], 1), top, 1)
            cos = np.take_along_axis(c, top, 1)
            done = np.take_along_axis(np.concatenate([done, np.zeros(new.shape, bool)], 1), top, 1)
        if len(live):
            out_i[live], out_c[live] = ids, cos
        return out_i, out_c

    def _prune(self, rows: np.ndarray, cand: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Robust pruning: takes the nearest, drops what is alpha times nearer to it than to the row."""
        out = np.full((len(rows), self.degree), -1)
        for a in range(0, len(rows), 2048):
            c, w = cand[a : a + 2048], cos[a : a + 2048]
            o = np.argsort(-w, axis=1, kind="stable")
            c, w = np.take_along_axis(c, o, 1), np.take_along_axis(w, o, 1)
            v = self.x[c]
            far = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))  # squared distances between candidates
            own = 2 - 2 * w
            alive = c >= 0
            r = np.arange(len(c))
            for k in range(self.degree):
                p = alive.argmax(1)
                ok = alive[r, p]
                out[a : a + 2048][ok, k] = c[r, p][ok]
                alive &= self.alpha2 * far[r, p] > own
                alive[r, p] = False
        return out

    def build(self, rounds: int = 1) -> Graph:
        """Searches propose, pruning keeps diverse edges, reverse edges are added and pruned."""
        for _ in range(rounds):
            rows = self.big
            if not len(rows):
                break
            ids, cos = self.search(rows, self.beam)
            kept = self._prune(rows, ids, cos)
            src = np.repeat(rows, self.degree)
            dst = kept.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            w = np.einsum("ij,ij->i", self.x[src], self.x[dst])
            o = np.lexsort((-w, dst))
            src, dst = src[o], dst[o]
            rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
            use = rank < self.degree
            back = np.full((len(self.x), self.degree), -1)
            back[dst[use], rank[use]] = src[use]
            self.near[rows] = kept
            both = np.concatenate([kept, back[rows]], 1)
            twice = (both[:, self.degree :, None] == kept[:, None, :]).any(2)
            both[:, self.degree :][twice] = -1
            c = np.concatenate([_dots(self.x, self.x[rows[a : a + 4096]], both[a : a + 4096]) for a in range(0, len(rows), 4096)])
            self.near[rows] = self._prune(rows, both, c)
        return self
