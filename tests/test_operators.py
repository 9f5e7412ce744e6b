import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import scores, text
from corpuslens.operators import contradictions as C
from corpuslens.operators import neighbourhood as N
from corpuslens.operators import text_dedup as T
from corpuslens.operators.chunking import pieces
from corpuslens.operators.components import components
from corpuslens.operators.grids import nearest_pairs
from corpuslens.operators.groups import dense_ids
from corpuslens.operators.ingest import apply_diff, snapshot_diff
from corpuslens.operators.text_dedup import similar_texts, text_edges

CHUNK = "store_id string, collection string, chunk_id string, text string, version int, first_seen_by_pulse timestamp_ntz, last_seen_by_pulse timestamp_ntz, deleted_at timestamp_ntz"


def test_components(spark):
    e = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "q"), ("c", "a"), ("y", "x")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    got = {r.id: r.label for r in components(spark.createDataFrame(e, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["z"] == "z" and got["n040"] == "n000" and "q" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_snapshot_diff(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    old = [("s", "c", "1", "same", 1, t, t, None), ("s", "c", "2", "before", 3, t, t, None), ("s", "c", "3", "gone", 1, t, t, None),
           ("s", "c", "4", "dead", 1, t, t, t), ("s", "silent", "5", "kept", 1, t, t, None), ("s", "c", "6", "dead", 2, t, t, t)]
    inc = [("s", "c", "1", "same"), ("s", "c", "2", "after"), ("s", "c", "7", None), ("s", "c", "6", "alive")]
    o = spark.createDataFrame(old, CHUNK)
    i = spark.createDataFrame(inc, "store_id string, collection string, chunk_id string, text string")
    d = snapshot_diff(i, o)
    assert {r.chunk_id: (r.status, r.next_version) for r in d.collect()} == {
        "1": ("unchanged", 1), "2": ("updated", 4), "3": ("deleted", 1), "4": ("absent", 1), "5": ("absent", 1), "6": ("updated", 3), "7": ("new", 1)}
    n = {r.chunk_id: r for r in apply_diff(d, i, o, "2025-01-01").collect()}
    assert n["6"].deleted_at is None and n["3"].deleted_at is not None and n["4"].deleted_at is not None and n["2"].text == "after"


@pytest.mark.parametrize(("a", "b", "hit"), [
    ("the widget is 100 dollars", "the widget is 200 dollars", True), ("the widget is 100 dollars", "the widget is 100 dollars", False),
    ("no numbers", "none here", False), ("costs 5", "quite another thing of 7 different words here", False)])
def test_numeric(spark, a, b, hit):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    s = text.numeric_contradiction(text.numbers("a"), text.numbers("b"), text.word_set(text.mask_numbers("a")), text.word_set(text.mask_numbers("b")))
    assert (df.select(s).first()[0] is not None) == hit


def test_extraction(spark):
    df = spark.createDataFrame([("1,000,000 and 1.2.3 and 2,5 but 5GB v2 x3 é5 Python v3.11",), (None,), ("",)], "t string")
    r = df.select(text.numbers("t"), text.versions("t"), F.size(text.words("t")), text.shingles_of(text.words("t"))).collect()
    assert r[0][0] == [0.0, 1.2, 3.0, 11.0, 25.0, 1000.0] and r[0][1] == ["1.2.3", "3.11"]
    assert r[1][0] == [] and r[1][3] == [""] and r[2][2] == 0


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.2999, 0.3, 0.6, 0.85, 1.0)], "s double")
    assert [r[0] for r in df.select(scores.staleness_label(F.col("s"))).collect()] == ["fresh", "fresh", "aging", "stale", "abandoned", "abandoned"]


def test_best_threshold(spark):
    rows = [(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.2, False), (None, True)]
    df = spark.createDataFrame(rows, "score double, positive boolean")
    r = C.best_threshold(df).first()
    assert r.threshold == 0.8 and r.n_labels == 5
    assert C.best_threshold(df.limit(3)).first().threshold == 0.5
    assert C.best_threshold(df.limit(0)).first().threshold == 0.5


def test_model_scores(spark):
    df = spark.createDataFrame([("a", "b", "x", "y"), ("c", "d", None, "z")], "chunk_a string, chunk_b string, text_a string, text_b string")
    r = C.fuse(C.model_scores(df, lambda ps: [{"contradiction": 0.92 if p[0] == "x" else 0.05} for p in ps]), 0.5).collect()
    assert [(x.chunk_a, x.direction, x.raw_score) for x in r] == [("a", "a->b", 0.92)]
    with pytest.raises(Exception, match="contradiction"):
        C.model_scores(df, lambda ps: [{"neutral": 1.0} for _ in ps]).collect()


def test_hdbscan_finds_three_clusters():
    rng = np.random.RandomState(0)
    x = np.concatenate([np.eye(8)[i] + rng.randn(8, 8) * 0.05 for i in range(3)] + [rng.randn(3, 8) * 3])
    lab = N.hdbscan(x, 5)
    groups = [set(lab[i * 8 : i * 8 + 8]) for i in range(3)]
    assert all(len(g) == 1 and -1 not in g for g in groups) and len({min(g) for g in groups}) == 3
    assert (N.hdbscan(x[:3], 5) == -1).all()


def test_density_clusters(spark):
    rng = np.random.RandomState(1)
    rows = [(f"c{i}-{j}", (np.eye(8)[i] + rng.randn(8) * 0.05).tolist()) for i in range(3) for j in range(8)] + [(f"noise{i}", (np.eye(8)[5 + i] * 3).tolist()) for i in range(3)]
    rows += [rows[0], ("bad", None), ("zero", [0.0] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    near = nearest_pairs(df, "chunk_id", "embedding", 10, 0.8, dim=8)
    got = N.density_clusters(near).collect()
    assert {r.cluster_key for r in got} == {"c0-0", "c1-0", "c2-0"} and len(got) == 24
    ids = {r.chunk_id: r.cluster_id for r in N.assigned(N.density_clusters(near)).collect()}
    assert {ids["c0-3"], ids["c1-3"], ids["c2-3"]} == {0, 1, 2}
    clustered = df.join(N.assigned(N.density_clusters(near)), "chunk_id").dropDuplicates(["chunk_id"])
    s = N.silhouette(clustered, dim=8).first()
    assert s.n_clusters == 3 and s.n_clustered == 24 and s.silhouette > 0.9
    assert N.silhouette(clustered.filter("cluster_id = 0"), dim=8).first().silhouette is None
    assert nearest_pairs(df.limit(0), "chunk_id", "embedding", 10, 0.8, dim=8).count() == 0


def test_nearest_pairs_of_copies(spark):
    rng = np.random.RandomState(2)
    v = rng.randn(16)
    rows = [(f"s{i:03}", (v * (1 + i % 3)).tolist()) for i in range(60)] + [(f"t{i}", (v + rng.randn(16) * 0.1).tolist()) for i in range(5)]
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = np.round(np.minimum(x @ x.T, 1), 9)
    names = [r[0] for r in rows]
    want = {(names[i], names[j]) for i in range(65) for j in sorted((j for j in range(65) if j != i and c[i, j] > 0.9), key=lambda j: (c[i, j], names[j]))[-4:]}
    got = nearest_pairs(spark.createDataFrame(rows, "chunk_id string, embedding array<float>"), "chunk_id", "embedding", 4, 0.9, dim=16)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_model_defaults():
    """Values of the documentation, by dimension: dedup, contradiction, density."""
    assert N.model_default(384) == (0.95, 0.85, 0.75) and N.model_default(1536) == (0.90, 0.78, 0.68)
    assert N.model_default(64) == (0.95, 0.85, 0.75) and N.model_default(800) == (0.93, 0.82, 0.72) and N.model_default(9000) == (0.88, 0.76, 0.65)
    assert N.model_default(1024) == (0.92, 0.80, 0.70) and N.model_default(None) == (0.92, 0.82, 0.72)


def test_detectors_count_all_members(spark):
    """Members without a number count for the limit of 50."""
    rows = [("a", 1, "the widget is 100 dollars", None), ("b", 1, "the widget is 200 dollars", None)] + [(f"x{i:02}", 1, "no numbers here", None) for i in range(48)]
    df = spark.createDataFrame(rows, "chunk_id string, cluster_id int, text string, deleted_at timestamp")
    assert C.numeric_hits(df).count() == 1
    assert C.numeric_hits(df.unionByName(spark.createDataFrame([("y", 1, None, None)], df.schema))).count() == 0


def test_detectors_in_large_clusters(spark):
    """Exactly the pairs of the plain rule, without its limit of 50."""
    r = np.random.RandomState(3)
    w = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:03}", 1 + i % 2, " ".join(r.choice(w[(i % 7) * 5:(i % 7) * 5 + 9], 8)) + f" {r.randint(3)} v1.{r.randint(3)}", None) for i in range(160)]
    rows += [("none", 1, None, None), ("few1", 3, "a b 1", None), ("few2", 3, "a b 2", None)]
    df = spark.createDataFrame(rows, "chunk_id string, cluster_id int, text string, deleted_at timestamp")
    for hits, mask, feature, score in ((C.numeric_hits, text.mask_numbers, text.numbers, text.numeric_contradiction), (C.version_hits, text.mask_versions, text.versions, text.version_contradiction)):
        f = df.filter("cluster_id < 3").select("cluster_id", "chunk_id", feature("text").alias("n"), text.word_set(mask("text")).alias("c"))
        a, b = (f.select("cluster_id", *[F.col(x).alias(f"{x}_{s}") for x in ("chunk_id", "n", "c")]) for s in "ab")
        j = a.join(b, "cluster_id").filter("chunk_id_a < chunk_id_b").withColumn("s", score(*(F.col(x) for x in ("n_a", "n_b", "c_a", "c_b")))).filter("s is not null")
        want = {(x.chunk_id_a, x.chunk_id_b, x.s) for x in j.collect()}
        got = {(x.chunk_a, x.chunk_b, x.raw_score) for x in hits(df, large=True).collect()}
        assert got == want and len(want) > 50 and {x.chunk_a for x in hits(df).collect()} == {"few1"} if hits is C.numeric_hits else got == want


@pytest.mark.parametrize(("name", "want"), [("My Source!!", "my-source"), ("__a--b__", "a-b"), ("ab", "doc-ab"), ("", "doc-pdf"), (None, "doc-pdf"), ("--", "doc-pdf"), ("x" * 70, "x" * 60), ("Größe 5", "gr-e-5")])
def test_slug(spark, name, want):
    assert spark.createDataFrame([(name,)], "s string").select(text.slug("s")).first()[0] == want


def test_pieces():
    """Cuts at 800 signs, 100 of overlap, full stops of the last 120 signs, spaces of the last 60."""
    assert pieces(None) == [] and pieces("") == [] and pieces("a b") == ["a b"] and pieces("  ") == ["  "]
    assert pieces("x" * 2000) == ["x" * 800, "x" * 800, "x" * 600]
    w = "word " * 1000
    p = pieces(w)
    assert p[0] == w[:800].strip() and p[1] == w[700:1500].strip() and all(len(x) <= 800 for x in p)
    t = "y" * 700 + ". " + "z" * 900
    assert pieces(t) == ["y" * 700 + ".", ("y" * 99 + ". " + "z" * 699), "z" * 301]


def test_text_edges(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [("1", a), ("2", a + " fifteen"), ("3", a), ("4", None), ("5", "!!"), ("6", "other words altogether")]
    e = {tuple(sorted((r.a, r.b))) for r in text_edges(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert e == {("1", "2"), ("1", "3"), ("4", "5")}


def shuffled(spark) -> int:
    """Bytes that the stages so far have written for shuffles."""
    j = spark._jvm
    none = spark.sparkContext._gateway.new_array(j.double, 0)
    got = spark._jsc.sc().statusStore().stageList(None, False, False, none, j.java.util.ArrayList())
    return sum(got.apply(i).shuffleWriteBytes() for i in range(got.size()))


def family(seed: int, n: int, words: int = 60) -> list[tuple[str, str]]:
    """n texts, a third of them edited copies of others, with a common opening."""
    r = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        w = rows[r.randint(len(rows))][1].split()[4:] if i % 3 == 2 else [f"w{x}é" for x in r.randint(9000, size=words)]
        for _ in range(r.randint(4)):
            w[r.randint(len(w))] = f"x{r.randint(9000)}"
        rows.append((f"c{i:05}", " ".join(["the", "same", "opening", "words", *w])))
    return rows


def shingle_set(t: str | None) -> frozenset:
    w = (t or "").lower().split()
    return frozenset([tuple(w)] if len(w) < 3 else zip(w, w[1:], w[2:]))


def test_text_dedup_groups_moves_little(spark):
    """Whole shingle sets are larger than the texts and must not go through shuffles: less than 1.3 bytes for a byte of text."""
    rows = family(4, 6000)
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    assert text_edges(df).count() > 500
    assert shuffled(spark) - before < 1.3 * sum(len(t.encode()) for _, t in rows)


def test_dedup_merged_channels_moves_little(spark, tmp_path):
    """Its result is the one of the SQL, for less than 1.3 shuffled bytes for a byte of text."""
    from __spark_entry__ import oracle_sql, queries

    from oracle import compare

    rows = family(6, 6000)
    spark.createDataFrame([(*x, None, None) for x in rows], "chunk_id string, text string, resolved_timestamp timestamp_ntz, deleted_at timestamp_ntz").repartition(4).write.parquet(f"{tmp_path}/chunks.parquet")
    groups = [(f"c{i:05}", [f"c{i:05}", f"c{i + 7:05}", "gone"], ["embedding"] if i % 2 else ["text"]) for i in range(0, 5000, 25)]
    spark.createDataFrame(groups, "canonical_chunk_id string, member_chunk_ids array<string>, detection_channels array<string>").write.parquet(f"{tmp_path}/dedup_groups.parquet")
    before = shuffled(spark)
    assert compare(spark, str(tmp_path), queries()["dedup_merged_channels"], oracle_sql()["dedup_merged_channels"]) > 500
    assert shuffled(spark) - before < 1.3 * sum(len(t.encode()) for _, t in rows)


def test_text_jaccard_pairs_move_little(spark):
    """Pairs alone need neither whole sets in shuffles nor the copies."""
    rows = family(7, 6000)
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    assert similar_texts(df).count() > 500
    assert shuffled(spark) - before < 1.3 * sum(len(t.encode()) for _, t in rows)


def test_similar_texts_is_brute_force(spark):
    rows = family(5, 240) + [("n", None), ("e", ""), ("s1", "a"), ("s2", "a b"), ("s3", "b a"), ("s4", "a b"), ("c00003x", family(5, 240)[3][1])] + [family(5, 240)[7]]
    rows += [("long1", " ".join(f"l{i}" for i in range(9000))), ("long2", " ".join(f"l{i}" for i in range(300, 9100)))]
    lead: dict[tuple, str] = {}
    for c, t in rows:
        w = tuple((t or "").lower().split())
        lead[w] = min(c, lead.get(w, c))
    v = sorted((c, shingle_set(" ".join(w))) for w, c in lead.items())
    want = {(a, b): len(x & y) / len(x | y) for i, (a, x) in enumerate(v) for b, y in v[i + 1 :] if x & y and len(x & y) / len(x | y) >= 0.8}
    got = [tuple(r) for r in similar_texts(spark.createDataFrame(rows, "chunk_id string, text string")).collect()]
    assert len(got) == len(want) > 30 and {(a, b): j for a, b, j in got} == want


def test_shingles_of_any_cut(monkeypatch):
    """The same sets however the batch is cut, with empty, short and very long texts."""
    import pyarrow as pa

    t = [" ".join(f"ü{x}" for x in np.random.RandomState(i).randint(50, size=n)) for i, n in enumerate((0, 1, 2, 3, 4, 90, 7000, 0, 5, 0))]
    b = pa.RecordBatch.from_arrays([pa.array(["cut off", *t])], names=["line"]).slice(1)
    h, n = T._sets(b.column(0), 3)
    assert n.tolist() == [len(shingle_set(x)) for x in t] and len(set(h.tolist())) == len(set().union(*map(shingle_set, t)))
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(T, "BYTES", 100)
    parts = list(T._slices(b, 0))
    assert len(parts) > 3 and sum(p.num_rows for p in parts) == len(t)
    assert np.concatenate([T._sets(p.column(0), 3)[0] for p in parts]).tolist() == h.tolist()


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"chunk-{i:03}",) for i in range(50)], "label string").repartition(5)
    got = sorted((r.label, r.group_id) for r in dense_ids(df).collect())
    assert [g for _, g in got] == list(range(50))
    assert dense_ids(df.limit(0)).count() == 0
