import numpy as np
import pytest

from corpuslens.llm import neighbours as neighbours_module
from corpuslens.llm.clusters import clusters, typical_members
from corpuslens.llm.graph import Graph
from corpuslens.llm.neighbours import neighbours, pairs_of, search
from corpuslens.llm.links import fragments
from corpuslens.operators import grids as vectors
from corpuslens.operators.grids import refinement

rng = np.random.RandomState(4)


def data(groups=12, size=15, dim=64, noise=0.4):
    rows = []
    for g in range(groups):
        c = rng.randn(dim)
        c /= np.linalg.norm(c)
        for i in range(size if g % 3 else 5):
            v = c + rng.randn(dim) * noise / np.sqrt(dim)
            rows.append((f"g{g:02}-{i:02}", (v * rng.choice([0.5, 1, 3])).astype(np.float32).tolist()))
    rows += [(f"r{i:03}", rng.randn(dim).astype(np.float32).tolist()) for i in range(60)]
    return rows


def bad(rows):
    v = rows[0][1]
    return [("b0", None), ("b1", [0.0] * 64), ("b2", v[:63]), ("b3", [float("nan"), *v[1:]]), ("b4", [float("inf"), *v[1:]]), ("b5", []), ("b6", [None, *v[1:]]), (None, v)]


def brute(rows):
    ids = sorted({i for i, _ in rows})
    v = np.array([dict(rows)[i] for i in ids], np.float64)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    return ids, np.round(u @ u.T, 12)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows + rows[:7] + bad(rows)], "cid string, emb array<float>, id string, cell int").repartition(3)


def test_clusters(spark):
    rows = data()
    df = frame(spark, rows)
    ids, s = brute(rows)
    lab = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            lab[i] = min(lab[j] for j in np.flatnonzero(s[i] >= 0.82))
    want = {(ids[lab[i]], ids[i]) for i in range(len(ids)) if lab.count(lab[i]) >= 8}
    got = {(r.cluster_key, r.name) for r in clusters(df, "cid", "emb", 0.82).collect()}
    assert got == want and got
    t = typical_members(df, "cid", "emb", 0.82).collect()
    assert {r.cluster_key for r in t} == {k for k, _ in want} and all(r.rank <= 3 for r in t)
    assert clusters(df.limit(0), "cid", "emb", 0.82).count() == 0


def test_identical_vectors(spark):
    v = rng.randn(64).astype(np.float32).tolist()
    rows = [(f"s{i:04}", v) for i in range(3000)] + data(2)
    got = clusters(frame(spark, rows), "cid", "emb", 0.82).filter("cluster_key = 's0000'").count()
    assert got == 3000


def components_of(rows, cut, least):
    ids, s = brute(rows)
    lab = np.arange(len(ids))
    i, j = np.nonzero(s >= cut)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    n = np.bincount(lab, minlength=len(ids))
    return {(ids[lab[k]], ids[k]) for k in range(len(ids)) if n[lab[k]] >= least}


def top(rows, k, least):
    ids, s = brute(rows)
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


def simple(spark, rows):
    return spark.createDataFrame(rows, "cid string, emb array<float>").repartition(4)


def loose(groups, size, spread, noise, seed):
    """Groups near one axis whose members have few partners over the cut."""
    r = np.random.RandomState(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    c = unit(np.eye(1, 64) + spread * unit(r.randn(groups, 64)))
    return [(f"l{g:04}-{i:02}", unit(c[g] + noise * unit(r.randn(64))).astype(np.float32).tolist()) for g in range(groups) for i in range(size)]


def test_loose_clusters(spark):
    rows = loose(150, 12, 1.2, 0.5, 21)
    want = components_of(rows, 0.82, 8)
    got = {(r.cluster_key, r.name) for r in clusters(simple(spark, rows), "cid", "emb", 0.82).collect()}
    assert len(want) > 300 and len(got & want) / len(want) >= 0.99 and len(got & want) / len(got) >= 0.99, (len(want), len(got), len(got & want))


def test_hot_cells_are_refined(spark, monkeypatch):
    c = rng.randn(64)
    rows = [(f"s{i:04}", (c + rng.randn(64) * 0.2).astype(np.float32).tolist()) for i in range(600)]
    line = rng.randn(64)
    far = rng.randn(64)
    rows += [(f"t{i:04}", (far + line * (i + 1) / 3000).astype(np.float32).tolist()) for i in range(300)]
    df = simple(spark, rows)
    monkeypatch.setattr(vectors, "CELL_ROWS", 60)
    v = vectors.distinct_vectors(df, "cid", "emb", 64)
    cells = vectors.gridded(v, 64, [0, 1], 900).collect()
    inside, blocks = {}, {}
    for x in cells:
        inside.setdefault((x.cell, x.block >> 24), set()).add(x.id)
        blocks.setdefault((x.cell, x.block), set()).add(x.id)
    met = {(k[0], k[1] >> 24, a, b) for k, y in blocks.items() for a in y for b in y}
    assert max(len(y) for y in blocks.values()) < 2 * 60 and max(map(len, inside.values())) > 100
    assert all((*k, a, b) in met for k, y in inside.items() for a in y for b in y)
    got = {(r.cluster_key, r.name) for r in clusters(df, "cid", "emb", 0.82).collect()}
    assert {n for k, n in got if k == "s0000"} == {i for i, _ in rows if i[0] == "s"}
    assert {n for k, n in got if k == "t0000"} == {i for i, _ in rows if i[0] == "t"}


def test_neighbours(spark):
    rows = data(noise=0.35)
    df = frame(spark, rows)
    ids, s = brute(rows)
    np.fill_diagonal(s, -2)
    want = set()
    for i, r in enumerate(s):
        for j in np.argsort(-r, kind="stable")[:3]:
            if r[j] >= 0.85:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    found = neighbours(df, "cid", "emb", 3, 0.85)
    got = {(r.chunk_a, r.chunk_b) for r in pairs_of(found).collect()}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95
    assert neighbours(df.limit(0), "cid", "emb", 3, 0.85).count() == 0


def test_large_groups_are_cut(spark, monkeypatch):
    from corpuslens.llm import neighbours as M

    monkeypatch.setattr(M, "SHARD_ROWS", 20)
    c = rng.randn(64)
    rows = [(f"s{i:04}", (c + rng.randn(64) * 0.25).astype(np.float32).tolist()) for i in range(300)]
    n = neighbours(frame(spark, rows), "cid", "emb", 3, 0.85).groupBy("a").count()
    assert n.count() > 290 and n.agg({"count": "max"}).first()[0] <= 3


def test_neighbours_of_copies(spark):
    v = rng.randn(64).astype(np.float32).tolist()
    rows = [(f"s{i:04}", v) for i in range(900)] + data(2, noise=0.35)
    n = [r for r in neighbours(frame(spark, rows), "cid", "emb", 3, 0.85).collect() if r.a[0] == "s"]
    got = {}
    for r in n:
        got.setdefault(r.a, set()).add(r.b)
    first = ["s0000", "s0001", "s0002", "s0003"]
    assert len(got) == 900 and all(b == set([x for x in first if x != a][:3]) for a, b in got.items())


def test_graph_ends_on_equal_vectors():
    x = np.tile(np.eye(1, 64, dtype=np.float32), (500, 1))
    g = Graph(x, np.zeros(500, int), np.full(500, 500)).build()
    assert (g.search(np.arange(500), 8)[1][:, 0] == 1).all()


def test_graph_recall():
    x = rng.randn(2000, 16).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = len(x)
    g = Graph(x, np.zeros(n, int), np.full(n, n), degree=16, beam=32).build(2)
    got, _ = g.search(np.arange(0, n, 50), 48)
    s = x[::50] @ x.T
    s[np.arange(len(s)), np.arange(0, n, 50)] = -2
    top = np.argsort(-s, axis=1)[:, :3]
    assert np.mean([len(set(a) & set(b[:3])) / 3 for a, b in zip(top.tolist(), got.tolist())]) >= 0.9


def test_fragments_dense_and_sparse():
    c = rng.randn(64)
    x = np.concatenate([c + rng.randn(900, 64) * 0.2, rng.randn(50, 64)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab, near = fragments(x, 0.82)
    assert (lab[:900] == 0).all() and len(set(lab[900:])) == 50


def test_refinement_grows():
    assert refinement(1000, 64) == [] and refinement(10**6, 64) == [16] and refinement(10**8, 64) == [64, 8] and len(refinement(10**12, 64)) == 4


@pytest.mark.parametrize("n", [600, 2000])
def test_neighbours_of_a_whole_group(spark, n):
    r = np.random.RandomState(n)
    c = r.randn(64)
    rows = [(f"n{i:05}", (c + r.randn(64) * 0.36).astype(np.float32).tolist()) for i in range(n)]
    want = top(rows, 3, 0.85)
    got = {(x.a, x.b) for x in neighbours(simple(spark, rows), "cid", "emb", 3, 0.85).collect()}
    assert len(want) > n and len(want & got) / len(want) >= 0.95, len(want & got) / len(want)


def test_neighbours_in_loose_groups(spark):
    rows = loose(100, 15, 1.5, 0.42, 5)
    want = top(rows, 3, 0.85)
    got = {(x.a, x.b) for x in neighbours(simple(spark, rows), "cid", "emb", 3, 0.85).collect()}
    assert len(want) > 1000 and len(want & got) / len(want) >= 0.97, len(want & got) / len(want)


def test_neighbours_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neighbours_module, "SHARD_ROWS", 150)
    r = np.random.RandomState(9)
    c = r.randn(64)
    rows = [(f"n{i:04}", (c + r.randn(64) * 0.35).astype(np.float32).tolist()) for i in range(700)]
    ids, s = brute(rows)
    np.fill_diagonal(s, -1)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:3] if s[i, j] >= 0.85}
    found = neighbours(spark.createDataFrame(rows, "cid string, emb array<float>"), "cid", "emb", 3, 0.85)
    got = [(x.a, x.b) for x in found.collect()]
    recall = len(want & set(got)) / len(want)
    assert len(want) > 1500 and len(got) == len(set(got)) and recall >= 0.99, recall


def test_search_without_a_threshold(spark):
    rows = data(20, noise=0.6) + [(f"u{i:04}", rng.randn(64).astype(np.float32).tolist()) for i in range(1500)]
    df = frame(spark, rows)
    want = {(a, b) for a, b in top(rows, 3, -1) if int(a[1:].replace("-", "")) % 5 == 0}
    asked = simple(spark, [r for r in rows if int(r[0][1:].replace("-", "")) % 5 == 0])
    got = {(r.a, r.b) for r in search(df, asked, "cid", "emb", 3, shard_rows=512).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.95, len(got & want) / len(want)
    assert search(df.limit(0), asked, "cid", "emb", 3).count() == 0 and search(df, asked.limit(0), "cid", "emb", 3).count() == 0
