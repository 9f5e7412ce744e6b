import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.plans import scan as S
from corpuslens.sources import config
from corpuslens.sources.control import Control

YAML = {"inference": {"nli_model": "m"}, "ingest": {"fetch_budget_secs": 60}, "scan": {"contradiction_candidates_per_chunk": 3},
        "collections": [{"name": "col", "timestamp_field": "created_at", "half_life_days": 30}], "clustering": {"min_cluster_size": "auto", "auto_tune_clustering": True}}


def store(path, rows, name="col"):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps(rows))
    return str(path)


def row(i, text, v, day="2024-01-01"):
    return {"id": f"chunk-{i:03}", "text": text, "embedding": [float(x) for x in v], "metadata": {"created_at": f"{day}T00:00:00Z"}}


def base():
    return [row(i, f"text number {i}", [i, i, i, i], f"2024-01-0{i + 1}") for i in range(5)]


def test_ingest_of_a_changing_folder(spark, tmp_path):
    s = config.parse(YAML | {"fixture_dir": store(tmp_path / "in", base())})
    c = Control(spark, str(tmp_path / "out"))
    n = lambda run: {k: v for k, v in S.ingest(c, s, run).items() if k != "elapsed_secs"}
    assert n("r1") == {"new": 5, "unchanged": 0, "updated": 0, "deleted": 0}
    assert n("r2") == {"new": 0, "unchanged": 5, "updated": 0, "deleted": 0}
    rows = base()
    rows[1]["text"] = "edited"
    store(tmp_path / "in", rows[:4])
    assert n("r3") == {"new": 0, "unchanged": 3, "updated": 1, "deleted": 1}
    got = {r.chunk_id: r for r in c.read("chunks").collect()}
    assert got["chunk-001"].version == 2 and got["chunk-001"].text == "edited" and got["chunk-004"].deleted_at is not None
    assert str(got["chunk-002"].resolved_timestamp) == "2024-01-03 00:00:00" and got["chunk-002"].timestamp_source == "metadata_field"
    runs = c.read("scan_runs").orderBy("started_at").collect()
    assert [r.run_id for r in runs] == ["r1", "r2", "r3"] and json.loads(runs[2].stats)["deleted"] == 1 and json.loads(runs[0].config)["pair_model"] == "m"
    store(tmp_path / "in", [row(0, "x", [1] * 6)])
    with pytest.raises(ValueError, match="dimension"):
        S.ingest(c, s, "r4")


def test_budget_deletes_nothing(spark, tmp_path):
    s = config.parse(YAML | {"store": {"type": "paged", "connection": {"client": "corpuslens.sources.paged:MemoryStore", "collection_prefix": "prod_"}}})
    c = Control(spark, str(tmp_path / "out"))
    assert S.ingest(c, s, "r1")["new"] == 8
    s.fetch_budget_secs = -1
    n = S.ingest(c, s, "r2")
    assert n["deleted"] == 0 and n["unchanged"] == 0 and c.read("chunks").filter("deleted_at is not null").count() == 0


def corpus():
    r = np.random.RandomState(6)
    rows = []
    for g in range(3):
        for j in range(8):
            v = np.eye(8)[g] + r.randn(8) * 0.05
            rows.append(row(g * 8 + j, f"the product {'abc'[g]} costs {100 + j % 2} euros in the shop of the town since version 1.{j % 3} was out", v, f"2025-0{1 + j}-01"))
    rows += [row(24 + k, f"{k} entirely different words about nothing else", np.eye(8)[5 + k]) for k in range(3)]
    return [*rows, row(27, rows[0]["text"], np.eye(8)[0] + 0.001, "2025-12-01")]


def test_whole_scan(spark, tmp_path):
    s = config.parse(YAML | {"fixture_dir": store(tmp_path / "in", corpus()), "thresholds": {"dedup": 0.999, "density": 0.8, "contradiction": 0.5}})
    out = str(tmp_path / "out")
    got = S.scan(spark, s, out, "run-1", now="2026-01-01 00:00:00")
    assert got["ingest"]["new"] == 28 and got["clusters"]["clusters"] == 3 and got["clusters"]["noise"] == 3
    assert got["triage"]["scored"] == 25 == got["triage"]["allowed"] and got["contradictions"]["numeric"] > 0 and got["contradictions"]["version"] > 0
    c = Control(spark, out)
    cal = c.latest_calibration()
    assert (cal["dedup_threshold"], json.loads(cal["distributions"])["method"]) == (0.95, "model_defaults") and len(cal["sample_hash"]) == 64
    assert c.read("clusters").count() == 25 and c.read("cluster_centroids").count() == 3 and c.read("chunks").filter("cluster_id is null").count() == 3
    groups = c.read("dedup_members").collect()
    assert {"chunk-000", "chunk-027"} <= {r.chunk_id for r in groups if r.canonical_chunk_id == "chunk-027"}
    assert c.read("triage_log").filter("was_scanned and components.cluster_factor is not null").count() == 25
    assert sum(got["staleness"].values()) == 28 and c.read("chunks").filter("staleness_components.age_decay > 0.9").count() > 0
    sections = {n: spark.read.json(f"{got['report']}/{n}") for n in ("staleness", "contradictions", "dedup_groups", "collections")}
    assert sections["staleness"].count() == 28 and sections["contradictions"].filter("text_a is not null and text_b is not null").count() == sum(got["contradictions"].values())
    assert "Scan complete [run-1]" in S.summary(got)
    # A second run of the same id without detectors leaves none of their rows; verdicts retune the pair threshold.
    s.numeric_detector = False
    again = S.scan(spark, s, out, "run-1", now="2026-01-01 00:00:00", predict=lambda p: [{"contradiction": 0.92 if a < b else 0.05} for a, b in p])
    assert again["contradictions"]["numeric"] == 0 and again["ingest"]["unchanged"] == 28 and again["contradictions"]["nli"] > 0
    con = c.read("contradictions")
    assert con.filter("detector = 'nli'").select("direction").distinct().count() >= 1 and con.filter("scan_run_id != 'run-1'").count() == 0
    assert c.read("calibration").filter(F.col("seq") == 1).count() == 1 and "nli_score_threshold" in json.loads(c.latest_calibration()["distributions"])


def test_nothing_to_scan(spark, tmp_path):
    s = config.parse(YAML | {"fixture_dir": store(tmp_path / "in", [])})
    got = S.scan(spark, s, str(tmp_path / "out"), "r")
    assert got["ingest"]["new"] == 0 and got["clusters"]["clusters"] == 0 and got["contradictions"] == {"nli": 0, "numeric": 0, "version": 0}


def test_large_corpus_is_sampled(spark, tmp_path):
    r = np.random.RandomState(3)
    s = config.parse(YAML | {"fixture_dir": store(tmp_path / "in", [row(i, f"t {i}", r.randn(4)) for i in range(600)])})
    c = Control(spark, str(tmp_path / "out"))
    S.ingest(c, s, "r1")
    t = S.calibrate(c, s, "r1")
    info = json.loads(c.latest_calibration()["distributions"])
    assert info["method"] == "sample" and info["corpus_size"] == 600 and info["percentiles"]["neighbour"]["n"] == 6000
    assert S.calibrate(c, s, "r2") == t and c.read("calibration").count() == 1


def test_configuration_file(tmp_path):
    config.write(YAML, str(tmp_path / "c.yaml"))
    s = config.load(str(tmp_path / "c.yaml"))
    assert (s.candidates_per_chunk, s.fetch_budget_secs, s.auto_tune, s.timestamp_fields, s.half_life_by_collection) == (3, 60, True, {"col": "created_at"}, {"col": 30})
    with pytest.raises(ValueError):
        config.write({}, str(tmp_path / "d.yaml"))
