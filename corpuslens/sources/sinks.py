"""Writers: tables replaced by run, snapshots, the report document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_runs(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces only the partitions that df has rows for (per run, or per run and detector)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(calibrations: DataFrame) -> DataFrame:
    """The newest calibration: the highest seq."""
    return calibrations.agg(F.max_by(F.struct(*calibrations.columns), "seq").alias("r")).select("r.*")


def write_report(head: dict, sections: dict[str, DataFrame], folder: str, run_id: str) -> str:
    """report-<run>/: head.json for the fixed-size part and one JSON-lines folder a section.

    The sections grow with the corpus and are written by the executors.
    """
    spark = next(iter(sections.values())).sparkSession
    base = f"{folder}/report-{run_id}"
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{base}/{name}")
    spark.createDataFrame([(json.dumps(head, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/head")
    return base
