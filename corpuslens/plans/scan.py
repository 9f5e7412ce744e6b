"""A whole scan: ingest, calibration, dedup, clusters, triage, contradictions, staleness, report; and the command line.

Each stage reads the control tables of the stages before it and writes its own. Driver state is
counts, thresholds and at most a calibration sample of fixed size.
"""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import scores
from corpuslens.functions.text import preview
from corpuslens.operators import contradictions as C
from corpuslens.operators import neighbourhood as N
from corpuslens.operators import staleness as S
from corpuslens.operators.components import components
from corpuslens.operators.grids import nearest_pairs
from corpuslens.operators.groups import dense_ids
from corpuslens.operators.ingest import KEY, snapshot_diff
from corpuslens.operators.instants import resolve_instants
from corpuslens.operators.text_dedup import text_edges
from corpuslens.operators.triage import allowed, priorities
from corpuslens.session import Stage, build_session
from corpuslens.sources import collections as J
from corpuslens.sources import config
from corpuslens.sources.control import Control, utc_now
from corpuslens.sources.paged import PagedStore
from corpuslens.sources.sinks import write_report
from corpuslens.sources.tables import load

GROWTH = 0.5  # a corpus that grew by more is calibrated anew
NLI_HIT = 0.5  # score over which a judged pair is a contradiction, before verdicts retune it
Predict = Callable[[list[tuple[str, str]]], list[dict]]


def read_source(spark: SparkSession, s: config.Settings) -> tuple[str, DataFrame, DataFrame]:
    """(store id, records, collections that were read whole).

    A paged store stops at the fetch budget: pages not begun by then are left out, and their
    collections are not whole, so nothing of them counts as deleted.
    """
    if s.store == "paged":
        spark.dataSource.register(PagedStore)
        options = {"client": s.client, "prefix": s.prefix, "deadline": str(time.time() + s.fetch_budget_secs)}
        df = spark.read.format("paged_store").options(**options).load()
        df = Stage(spark, "fetched").put(df, "records")  # fetched once
        there = spark.createDataFrame(PagedStore.counts(options), "collection string, n long")
        whole = there.join(df.groupBy("collection").agg(F.count("*").alias("got")), "collection").filter("got >= n").select("collection")
        return J.store_id("paged", s.client), df, whole
    if s.store == "parquet":
        r = load(spark, s.path, "chunk_records")
        last = r.groupBy("collection", "chunk_id").agg(F.max_by(F.struct("text", "embedding", "metadata"), "record_no").alias("r"))
        df = last.select("collection", "chunk_id", "r.*")
    else:
        df = J.scan_json(spark, s.path)
    return J.store_id(s.store, s.path), df, df.select("collection").distinct()


def ingest(control: Control, s: config.Settings, run_id: str) -> dict:
    """The next chunks snapshot and a scan_runs row; counts by status."""
    spark, began = control.spark, utc_now()
    store, records, whole = read_source(spark, s)
    old = control.read("chunks")
    dim = old.filter("embedding is not null").select(F.size("embedding")).limit(1).collect()
    J.check_dimension(records, dim[0][0] if dim else None)
    stamp = F.create_map(*[F.lit(x) for kv in (s.timestamp_fields or {"": ""}).items() for x in kv])
    stamp = F.try_element_at(stamp, F.col("collection"))
    own = F.when(stamp.isNull(), F.col("metadata")).otherwise(F.map_from_arrays(
        F.array(F.lit("created_at"), F.lit("tz")), F.array(F.try_element_at("metadata", stamp), F.try_element_at("metadata", F.lit("tz")))))
    empty = spark.createDataFrame([], "collection string, default_tz string, date_order string")
    r = resolve_instants(records.filter("chunk_id is not null").dropDuplicates(["collection", "chunk_id"]).withColumn("metadata", own), empty)
    now = F.lit(str(began)).cast("timestamp_ntz")
    inc = r.select(F.lit(store).alias("store_id"), "collection", "chunk_id", "text", "embedding",
                   F.coalesce(F.timestamp_micros("utc_us").cast("timestamp_ntz"), now).alias("resolved_timestamp"), F.coalesce("instant_source", F.lit("first_seen")).alias("timestamp_source"))
    inc = Stage(spark, "incoming").put(inc, "records")
    d = snapshot_diff(inc, old, whole)
    st = F.col("status")
    fresh = st.isin("new", "updated")
    i = inc.select(*KEY, F.struct("text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), "embedding", "resolved_timestamp", "timestamp_source").alias("i"))
    o = old.select(*KEY, F.struct(*[c for c in old.columns if c not in KEY]).alias("o"))
    j = d.join(i, KEY, "left").join(o, KEY, "left")
    cols = [F.when(fresh, F.col(f"i.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("text", "content_hash", "embedding", "resolved_timestamp", "timestamp_source")]
    kept = [F.col(f"o.{c}").alias(c) for c in ("cluster_id", "staleness_score", "staleness_label", "staleness_components")]
    nxt = j.select(*KEY, "status", *cols, *kept, F.coalesce("o.first_seen_by_pulse", now).alias("first_seen_by_pulse"),
                   F.when(st.isin("new", "updated", "unchanged"), now).otherwise(F.col("o.last_seen_by_pulse")).alias("last_seen_by_pulse"),
                   F.when(st == "updated", None).when(st == "deleted", now).otherwise(F.col("o.deleted_at")).alias("deleted_at"), F.col("next_version").alias("version"))
    nxt = Stage(spark, "snapshot").put(nxt, "chunks")
    n = {x["status"]: x["n"] for x in nxt.groupBy("status").agg(F.count("*").alias("n")).collect()}
    control.snapshot("chunks", nxt)
    stats = {k: n.get(k, 0) for k in ("new", "unchanged", "updated", "deleted")}
    stats["elapsed_secs"] = (utc_now() - began).total_seconds()
    control.append("scan_runs", {"run_id": run_id, "started_at": began, "finished_at": utc_now(), "config": s.asdict(), "stats": stats})
    return stats


def active_vectors(control: Control) -> DataFrame:
    return control.read("chunks").filter("deleted_at is null and embedding is not null")


def calibrate(control: Control, s: config.Settings, run_id: str) -> dict:
    """Thresholds: the stored ones, or new ones after the first scan or a growth by half; overrides win."""
    v = active_vectors(control)
    n, last = v.count(), control.latest_calibration()
    size = (N.json_of(last["distributions"]) if last else {}).get("corpus_size", 0)
    if last and size and (n - size) / size <= GROWTH:
        return {k: last[k] for k in ("dedup_threshold", "contradiction_threshold", "cluster_min_density")} | s.overrides()
    if not n:
        return dict(zip(("dedup_threshold", "contradiction_threshold", "cluster_min_density"), N.model_default(None))) | s.overrides()
    dim = v.select(F.size("embedding")).first()[0]
    info = {"dim": dim, "corpus_size": n, "model_family": scores.KNOWN_MODELS.get(dim, ["unknown"])}
    if n < s.small_corpus:
        got = dict(zip(("dedup_threshold", "contradiction_threshold", "cluster_min_density"), N.model_default(dim)))
        info["method"] = "model_defaults"
    else:
        sample = Stage(control.spark, "calibration").put(N.calibration_sample(v, "chunk_id", "embedding"), "sample")
        got = N.threshold_row(sample, dim).first().asDict()
        info |= {"method": "sample", "percentiles": {r["kind"]: r.asDict() for r in N.percentiles(sample).collect()}}
    control.append("calibration", {"seq": last["seq"] + 1 if last else 1, "scan_run_id": run_id, "sample_hash": N.sample_hash(v, "chunk_id").first()[0], **got, "distributions": info})
    return got | s.overrides()


def dedup(control: Control, threshold: float) -> dict:
    """Groups by vectors and by texts, merged where they share a chunk."""
    spark = control.spark
    c = control.read("chunks").filter("deleted_at is null")
    near = nearest_pairs(c.filter("embedding is not null").select("chunk_id", "embedding"), "chunk_id", "embedding", 10, threshold, _dim(c))
    e = near.select("a", "b").withColumn("channel", F.lit("embedding")).unionByName(text_edges(c).withColumn("channel", F.lit("text")))
    e = Stage(spark, "dedup").put(e, "edges")
    lab = Stage(spark, "dedup-labels").put(components(e.select("a", "b").filter("a != b")), "labels")
    ch = e.select(F.col("a").alias("id"), "channel").join(lab, "id").groupBy("label").agg(F.array_sort(F.collect_set("channel")).alias("detection_channels"))
    info = c.select(F.col("chunk_id").alias("id"), F.coalesce(F.unix_micros(F.col("resolved_timestamp").cast("timestamp")), F.lit(-(2**62)).cast("long")).alias("t"),
                    F.length(F.coalesce("text", F.lit(""))).alias("len"))
    best = F.min(F.struct((-F.col("t")).alias("t"), (-F.col("len")).alias("l"), F.col("id")))
    g = lab.join(info, "id").groupBy("label").agg(best.alias("m"), F.count("*").alias("n_members")).join(ch, "label")
    g = dense_ids(g).select("label", "group_id", F.col("m.id").alias("canonical_chunk_id"), "n_members", "detection_channels")
    g = Stage(spark, "dedup-groups").put(g, "groups")
    control.snapshot("dedup_groups", g)
    control.snapshot("dedup_members", lab.join(g, "label").select("group_id", "canonical_chunk_id", F.col("id").alias("chunk_id")))
    return {r["c"]: r["n"] for r in g.groupBy(F.array_join("detection_channels", "+").alias("c")).agg(F.count("*").alias("n")).collect()}


def _dim(c: DataFrame) -> int:
    one = c.filter("embedding is not null").select(F.size("embedding")).limit(1).collect()
    return one[0][0] if one else 1


def cluster(control: Control, s: config.Settings, density: float) -> dict:
    """New cluster ids of all active chunks with a vector, their centroids; old ids are reset."""
    spark, chunks = control.spark, control.read("chunks")
    v = chunks.filter("deleted_at is null and embedding is not null").select("chunk_id", "embedding")
    n, dim = v.count(), _dim(chunks)
    base = max(5, int(n**0.5 / 4)) if s.min_cluster_size == "auto" else int(s.min_cluster_size)
    near = Stage(spark, "clusters").put(nearest_pairs(v, "chunk_id", "embedding", 10, density, dim), "near")
    sizes = sorted({max(2, base // 2), base, base * 2}) if s.auto_tune and s.min_cluster_size == "auto" else [base]
    found = Stage(spark, "density").put(N.density_clusters(near, min_size=sizes[0]), "clusters")
    if len(sizes) > 1:
        tried = {m: N.silhouette(v.join(found.filter(F.col("n") >= m).select("chunk_id", F.col("cluster_key").alias("cluster_id")), "chunk_id"), dim=dim).first() for m in sizes}
        good = {m: r["silhouette"] for m, r in tried.items() if r and r["n_clusters"] >= 2 and r["silhouette"] is not None}
        base = max(good, key=lambda m: (good[m], -m)) if good else base
    ids = Stage(spark, "cluster-ids").put(N.assigned(found.filter(F.col("n") >= base)), "ids")
    cen = N.centroids(v.join(ids, "chunk_id").select("cluster_id", "embedding"), dim)
    control.snapshot("clusters", ids)
    control.snapshot("cluster_centroids", cen)
    control.snapshot("chunks", chunks.drop("cluster_id").join(ids, "chunk_id", "left").withColumn("cluster_id", F.when(F.col("deleted_at").isNull(), F.col("cluster_id"))))
    m = ids.count()
    return {"clusters": control.read("cluster_centroids").count(), "noise": n - m, "min_cluster_size": base}


def half_lives(spark: SparkSession, s: config.Settings) -> DataFrame:
    return spark.createDataFrame(list(s.half_life_by_collection.items()), "collection string, half_life_days int")


def triage(control: Control, s: config.Settings, run_id: str, now: str) -> DataFrame:
    """Writes the triage log; (chunk_id) of the chunks within the budget."""
    p = priorities(control.read("chunks"), half_lives(control.spark, s), now, parts=True)
    p = Stage(control.spark, "triage").put(p, "scored")
    top = allowed(p, s.cost_budget, s.candidates_per_chunk).select("chunk_id", F.lit(True).alias("was_scanned"))
    log = p.join(top, "chunk_id", "left").withColumn("was_scanned", F.coalesce("was_scanned", F.lit(False)))
    control.replace("triage_log", log, scan_run_id=run_id)
    return control.read("triage_log").filter((F.col("scan_run_id") == run_id) & F.col("was_scanned")).select("chunk_id")


def nli_threshold(control: Control) -> float:
    """Retuned from all verdicts so far; kept in the newest calibration."""
    c = control.read("contradictions").filter("user_resolution is not null and detector = 'nli'")
    r = C.best_threshold(c.select(F.col("raw_score").alias("score"), (F.col("user_resolution") == "confirmed").alias("positive"))).first()
    t = r["threshold"] if r["f"] > 0 else NLI_HIT
    control.recalibrated({"nli_score_threshold": t, "nli_f05": r["f"], "nli_n_labels": r["n_labels"]})
    return t


def contradictions(control: Control, s: config.Settings, run_id: str, candidate: float, hit: float, queries: DataFrame, predict: Predict | None) -> dict:
    """Judged pairs and detector hits of the run, each detector's partition replaced."""
    spark = control.spark
    c = control.read("chunks").filter("deleted_at is null and cluster_id is not null")
    pairs = N.cluster_cosines(c.filter("embedding is not null").select("cluster_id", "chunk_id", "embedding"), top=s.candidates_per_chunk, cap=s.max_cluster_size)
    groups = control.read("dedup_members").select("group_id", "chunk_id")
    cand = C.candidates(pairs.select("a", "b", "cosine"), groups, candidate, s.candidates_per_chunk, queries, members=True)
    t = c.select("chunk_id", "text")
    for x in "ab":
        cand = cand.join(t.select(F.col("chunk_id").alias(f"chunk_{x}"), F.col("text").alias(f"text_{x}")), f"chunk_{x}")
    judged = C.lexical_scores(cand) if predict is None else C.model_scores(cand, predict, s.batch_size)
    blank = {"calibrated_confidence": F.lit(None), "user_resolution": F.lit(None), "resolved_at": F.lit(None)}
    hits = {"nli": C.fuse(judged, hit).withColumns(blank | {"calibration_state": F.lit("calibrated" if hit != NLI_HIT else "uncalibrated")})}
    off = c.limit(0).select(F.col("chunk_id").alias("chunk_a"), F.col("chunk_id").alias("chunk_b"), F.lit(0.0).alias("raw_score"))
    for name, on, found in (("numeric", s.numeric_detector, C.numeric_hits), ("version", s.version_detector, C.version_hits)):
        got = found(control.read("chunks")) if on else off
        if on and s.large_clusters:
            got = got.unionByName(found(control.read("chunks"), large=True))
        hits[name] = got.withColumns(blank | {"direction": F.lit("both"), "calibration_state": F.lit("uncalibrated")})
    out = {}
    for name, df in hits.items():
        control.replace("contradictions", df, scan_run_id=run_id, detector=name)
        out[name] = control.read("contradictions").filter((F.col("scan_run_id") == run_id) & (F.col("detector") == name)).count()
    return out


def score_staleness(control: Control, s: config.Settings, now: str) -> dict:
    chunks = control.read("chunks")
    m = control.read("dedup_members").filter("chunk_id != canonical_chunk_id").select("chunk_id")
    r = S.scored(chunks.filter("deleted_at is null"), control.read("cluster_centroids"), S.evidence_counts(control.read("contradictions")), m,
                 half_lives(control.spark, s), F.lit(now).cast("timestamp"))
    r = r.select(*KEY, F.round("score", 4).alias("staleness_score"), F.col("label").alias("staleness_label"), F.col("components").alias("staleness_components"))
    nxt = chunks.drop("staleness_score", "staleness_label", "staleness_components").join(r, KEY, "left")
    old = chunks.select(*KEY, F.struct("staleness_score", "staleness_label", "staleness_components").alias("_o"))  # deleted chunks keep theirs
    for c in ("staleness_score", "staleness_label", "staleness_components"):
        nxt = nxt.withColumn(c, F.col(c))
    nxt = nxt.join(old, KEY).withColumns({c: F.when(F.col("deleted_at").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c)) for c in ("staleness_score", "staleness_label", "staleness_components")})
    done = control.snapshot("chunks", nxt).filter("deleted_at is null and staleness_label is not null")
    n = {x["staleness_label"]: x["n"] for x in done.groupBy("staleness_label").agg(F.count("*").alias("n")).collect()}
    return {k: n.get(k, 0) for k in scores.LABELS}


def report(control: Control, s: config.Settings, run_id: str, thresholds: dict, labels: dict, folder: str) -> dict:
    """The report's head (fixed size) and its sections, sorted, with both sides' texts."""
    c = control.read("chunks")
    groups, members = control.read("dedup_groups"), control.read("dedup_members")
    con = control.read("contradictions").filter(F.col("scan_run_id") == run_id)
    n = c.agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("active")).first()
    head = {"run_id": run_id, "generated_at": utc_now().isoformat() + "Z", "corpus_info": {"store_type": s.store, "total_chunks": n["total"], "active_chunks": n["active"]},
            "calibration": thresholds, "summary": {"dedup_groups": groups.count(), "chunks_in_dedup_groups": members.count(),
                                                   "contradictions_unresolved": con.filter("user_resolution is null").count(), "staleness_labels": labels}}
    t = c.select("chunk_id", "text", "collection", F.date_format("resolved_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("resolved_timestamp"))
    for x in "ab":
        con = con.join(t.select(F.col("chunk_id").alias(f"chunk_{x}"), F.col("text").alias(f"text_{x}"), F.col("collection").alias(f"collection_{x}")), f"chunk_{x}", "left")
    sup = members.filter("chunk_id != canonical_chunk_id").select("chunk_id").distinct().withColumn("is_superseded", F.lit(True))
    stale = c.filter("deleted_at is null and staleness_score is not null").join(sup, "chunk_id", "left").select(
        "chunk_id", "collection", preview("text", 200).alias("preview"), "staleness_score", "staleness_label", "staleness_components.*", F.coalesce("is_superseded", F.lit(False)).alias("is_superseded"))
    sections = {
        "collections": c.filter("deleted_at is null").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("chunk_count")).orderBy("name"),
        "dedup_groups": members.join(t, "chunk_id", "left").join(groups.select("group_id", "detection_channels"), "group_id").withColumn(
            "is_canonical", F.col("chunk_id") == F.col("canonical_chunk_id")).orderBy("group_id", "chunk_id"),
        "contradictions": con.orderBy("chunk_a", "chunk_b", "detector"),
        "staleness": stale.orderBy(F.desc("staleness_score"), "chunk_id")}
    head["path"] = write_report(head, sections, folder, run_id)
    return head


def scan(spark: SparkSession, s: config.Settings, folder: str, run_id: str | None = None, predict: Predict | None = None, now: str | None = None) -> dict:
    """One scan of a store into the control tables of a folder; the counts of all stages."""
    run_id, control = run_id or str(uuid.uuid4()), Control(spark, folder)
    out = {"run_id": run_id, "ingest": ingest(control, s, run_id)}
    now = now or str(utc_now())
    t = calibrate(control, s, run_id)
    t["nli_score_threshold"] = nli_threshold(control)
    out |= {"calibration": t, "dedup": dedup(control, t["dedup_threshold"]), "clusters": cluster(control, s, t["cluster_min_density"])}
    queries = triage(control, s, run_id, now)
    log = control.read("triage_log").filter(F.col("scan_run_id") == run_id)
    out["triage"] = log.agg(F.count("*").alias("scored"), F.count_if("was_scanned").alias("allowed")).first().asDict()
    out["contradictions"] = contradictions(control, s, run_id, t["contradiction_threshold"], t["nli_score_threshold"], queries, predict)
    out["staleness"] = score_staleness(control, s, now)
    out["report"] = report(control, s, run_id, t, out["staleness"], folder)["path"]
    return out


def summary(out: dict) -> str:
    """The counts of a scan as text."""
    lines = [f"Scan complete [{out['run_id'][:8]}]"]
    for title in ("ingest", "calibration", "dedup", "clusters", "triage", "contradictions", "staleness"):
        lines += ["", f"{title}:"] + [f"  {k + ':':<24}{v:.4f}" if isinstance(v, float) else f"  {k + ':':<24}{v}" for k, v in out[title].items()]
    return "\n".join([*lines, "", f"report: {out['report']}"])


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpuslens")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("--config", "-c", required=True)
    s.add_argument("--data-dir", required=True)
    s.add_argument("--run-id")
    c = sub.add_parser("calibrate")
    c.add_argument("--data-dir", required=True)
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    a = p.parse_args(args)
    spark = build_session()
    if a.command == "scan":
        print(summary(scan(spark, config.load(a.config), a.data_dir, a.run_id)))
    elif a.command == "calibrate":
        control = Control(spark, a.data_dir)
        print({"nli_score_threshold": nli_threshold(control), "calibration": control.latest_calibration()})
    else:
        from corpuslens.plans.registry import core_queries

        core_queries()[a.name](spark, a.data).show(50, truncate=60)


if __name__ == "__main__":
    main()
