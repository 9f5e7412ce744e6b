from datetime import datetime

from corpuslens.plans.registry import core_queries

Q = core_queries()
A = "Größe der Straße beträgt 12 Meter für jede Brücke im Süden Österreichs"


def write(spark, d):
    at = datetime(2026, 1, 1)
    t = [A, A.upper().replace("SS", "ß"), A.replace("12", "13"), "plain text v1.2", None]
    rows = [(f"c{i}", x, 1, None, at) for i, x in enumerate(t)] + [("gone", A, 1, at, at)]
    spark.createDataFrame(rows, "chunk_id string, text string, cluster_id int, deleted_at timestamp, resolved_timestamp timestamp").write.parquet(f"{d}/chunks.parquet")
    docs = [(1, "ﬁne\u200b  Ⅻ", "Süd"), (2, "a  b", "web"), (3, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")


def test_texts_of_any_script(spark, tmp_path):
    d = str(tmp_path)
    write(spark, d)
    rows = lambda n: [r.asDict() for r in Q[n](spark, d).collect()]
    n = {r["chunk_id"]: r["n_words"] for r in rows("text_shingles")}
    assert n["c0"] == len(A.split()) and len(n) == 6
    assert [(r["vid"], r["n"]) for r in rows("text_copies")] == [("c0", 2)]
    assert [r["n_members"] for r in rows("text_dedup_groups")] == [2]
    hits = {(r["chunk_a"], r["chunk_b"]): r["raw_score"] for r in rows("numeric_contradictions")}
    assert hits == {("c0", "c2"): 1.0, ("c1", "c2"): 1.0}
    assert {r["doc_id"]: r["n_clean"] for r in rows("clean_text")} == {1: len("fine XII"), 2: 3, 3: 0}
    assert {r["source"]: r["slug"] for r in rows("slugify")}["Süd"] == "s-d"
