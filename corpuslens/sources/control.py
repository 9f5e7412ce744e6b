"""Control tables of a scanner's folder: snapshots, logs and per-run tables as Parquet.

* Snapshots (chunks, dedup_groups, dedup_members, clusters, cluster_centroids) are written whole
  as a new version beside the old one, which is then removed; a reader takes the newest.
* Logs (scan_runs, calibration) are appended to; the newest calibration has the highest seq.
* Per-run tables (contradictions by run and detector, triage_log by run) replace exactly the
  partition that is written, also when there is nothing to write.

Defined results: a table that was never written reads as empty, with its schema.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import remove

SCHEMAS = {
    "chunks": "store_id string, collection string, chunk_id string, text string, content_hash string, resolved_timestamp timestamp_ntz, timestamp_source string, "
              "embedding array<float>, cluster_id int, staleness_score double, staleness_label string, "
              "staleness_components struct<age_decay: double, cluster_drift: double, contradiction_evidence: double, supersession_evidence: double>, "
              "first_seen_by_pulse timestamp_ntz, last_seen_by_pulse timestamp_ntz, deleted_at timestamp_ntz, version int",
    "dedup_groups": "group_id int, canonical_chunk_id string, n_members long, detection_channels array<string>",
    "dedup_members": "group_id int, canonical_chunk_id string, chunk_id string",
    "clusters": "cluster_id int, chunk_id string",
    "cluster_centroids": "cluster_id int, n_chunks long, centroid array<double>",
    "contradictions": "chunk_a string, chunk_b string, raw_score double, calibrated_confidence double, calibration_state string, direction string, "
                      "user_resolution string, resolved_at timestamp_ntz, scan_run_id string, detector string",
    "triage_log": "chunk_id string, priority double, components struct<age_factor: double, cluster_factor: double>, was_scanned boolean, scan_run_id string",
    "scan_runs": "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, config string, stats string",
    "calibration": "seq long, scan_run_id string, sample_hash string, dedup_threshold double, contradiction_threshold double, cluster_min_density double, distributions string",
}
KEYS = {"contradictions": ["scan_run_id", "detector"], "triage_log": ["scan_run_id"]}


class Control:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _versions(self, name: str) -> list[int]:
        if not self.exists(name):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        names = [s.getPath() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        done = [x for x in names if x.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName()[2:]) for x in done if x.getName().startswith("v="))

    def read(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        if name in KEYS or name in ("scan_runs", "calibration"):
            return self.spark.read.schema(empty.schema).parquet(self._path(name)) if self.exists(name) else empty
        v = self._versions(name)
        return self.spark.read.schema(empty.schema).parquet(f"{self._path(name)}/v={v[-1]}") if v else empty

    def snapshot(self, name: str, df: DataFrame) -> DataFrame:
        """Writes the next version of a table (df may read the one before) and drops the older ones."""
        v = self._versions(name)
        cols = self.spark.createDataFrame([], SCHEMAS[name]).schema
        df.select(*[F.col(f.name).cast(f.dataType) for f in cols]).write.mode("overwrite").parquet(f"{self._path(name)}/v={v[-1] + 1 if v else 1}")
        for old in v:
            remove(self.spark, f"{self._path(name)}/v={old}")
        return self.read(name)

    def append(self, name: str, row: dict) -> None:
        values = {k: json.dumps(x, default=str) if isinstance(x, dict) else x for k, x in row.items()}
        df = self.spark.createDataFrame([tuple(values[f.split()[0]] for f in SCHEMAS[name].split(", "))], SCHEMAS[name])
        df.coalesce(1).write.mode("append").parquet(self._path(name))

    def replace(self, name: str, df: DataFrame, **keys: str) -> None:
        """Replaces one partition of a per-run table; an empty df clears it."""
        part = "/".join(f"{k}={keys[k]}" for k in KEYS[name])
        cols = [f for f in self.spark.createDataFrame([], SCHEMAS[name]).schema if f.name not in KEYS[name]]
        remove(self.spark, f"{self._path(name)}/{part}")
        df.select(*[F.col(f.name).cast(f.dataType) for f in cols]).write.parquet(f"{self._path(name)}/{part}")

    def latest_calibration(self) -> dict | None:
        r = self.read("calibration").orderBy(F.desc("seq")).limit(1).collect()
        return r[0].asDict() if r else None

    def recalibrated(self, extra: dict) -> None:
        """Merges keys into the newest calibration's distributions: a row of the same run that supersedes it."""
        last = self.latest_calibration()
        if last:
            self.append("calibration", last | {"seq": last["seq"] + 1, "distributions": json.loads(last["distributions"]) | extra})


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
