import json

import pytest
from pyspark.sql import functions as F

from corpuslens.sources import collections as C
from corpuslens.sources import config, sinks
from corpuslens.sources.paged import PagedStore


@pytest.fixture
def folder(tmp_path):
    a = [{"id": "1", "text": "x", "embedding": [1.0, 0.0], "metadata": {"created_at": "2024-01-02T00:00:00Z"}},
         {"id": "2", "text": "y", "metadata": {"created_at": "junk"}}, {"id": "3", "text": "z", "embedding": None}]
    (tmp_path / "prod_a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "4", "text": "w", "embedding": [1.0, 2.0], "metadata": {"created_at": "2020-01-01"}}]))
    return str(tmp_path)


def test_scan(spark, folder):
    df = C.scan_json(spark, folder)
    assert {(r.collection, r.chunk_id) for r in df.collect()} == {("prod_a", "1"), ("prod_a", "2"), ("prod_a", "3"), ("b", "4")}
    assert df.filter("metadata is null").count() == 0
    assert [tuple(r) for r in C.catalogue(df).collect()] == [("b", 1), ("prod_a", 3)]
    assert [tuple(r) for r in C.catalogue(df, "prod_").collect()] == [("a", 3)]
    kept = C.scan_json(spark, folder, since="2023-01-01")
    assert {r.chunk_id for r in kept.collect()} == {"1", "2", "3"}


def test_lookup_and_dimension(spark, folder):
    df = C.scan_json(spark, folder)
    assert [r.chunk_id for r in C.embeddings_of(df, ["4", "1"]).collect()] == ["4", "1"]
    with pytest.raises(Exception, match="unknown chunk id"):
        C.embeddings_of(df, ["4", "nope"]).collect()
    assert C.check_dimension(df) == 2
    with pytest.raises(ValueError, match="dimension"):
        C.check_dimension(df, 3)


def test_paged_store(spark):
    spark.dataSource.register(PagedStore)
    df = spark.read.format("paged_store").option("client", "corpuslens.sources.paged:MemoryStore").option("prefix", "prod_").option("pageSize", 3).load()
    rows = df.collect()
    assert sorted(r.chunk_id for r in rows) == ["a0", "a1", "a2", "a3", "a4", "a5", "a6", "b0"]
    assert {r.collection for r in rows} == {"a", "b"}
    assert [r.text for r in rows if r.chunk_id == "b0"] == [""]


def test_config():
    s = config.parse({"inference": {"nli_model": "m"}, "scan": {"cost_budget": 10}, "collections": [{"name": "a", "half_life_days": 7}]})
    assert (s.cost_budget, s.half_life_by_collection, s.candidates_per_chunk) == (10, {"a": 7}, 5)
    with pytest.raises(ValueError):
        config.parse({})
    with pytest.raises(ValueError):
        config.parse({"inference": {"nli_model": "m"}, "store": {"type": "other"}})


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "c")
    df = spark.createDataFrame([("r1", "nli", 1), ("r1", "numeric", 2), ("r2", "nli", 3)], "scan_run_id string, detector string, v int")
    sinks.replace_runs(df, p, ["scan_run_id", "detector"])
    sinks.replace_runs(df.filter("v = 2").withColumn("v", F.lit(9)), p, ["scan_run_id", "detector"])
    assert sorted(r.v for r in spark.read.parquet(p).collect()) == [1, 3, 9]
    cal = spark.createDataFrame([(1, 0.5), (3, 0.7), (2, 0.6)], "seq int, t double")
    assert sinks.latest(cal).first().t == 0.7
    base = sinks.write_report({"run_id": "x"}, {"rows": df}, str(tmp_path), "x")
    assert spark.read.json(base + "/rows").count() == 3
