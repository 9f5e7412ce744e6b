"""Session settings and staging of intermediate results.

Iterative operators must cut their lineage. They do it by writing a Parquet table into the
folder named by ``spark.checkpoint.dir`` (shared by all executors), so that the loss of an
executor costs nothing but a re-read. Where the setting is absent (tests, notebooks on one
machine) a temporary folder takes its place; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def build_session(app: str = "corpuslens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``; in local mode else a temporary one of this process."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="corpuslens-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return _LOCAL_DIR[0]


def write_once(spark: SparkSession, write: Callable[[], None]) -> None:
    """Runs a write and lets its shuffle files go: what was written is read from its table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        write()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of staged data."""
    if not hasattr(spark, "_jvm"):
        return  # Spark Connect: the folder is emptied by its owner
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stage:
    """Numbered Parquet tables of one run of an operator under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """Writes df and returns the table read back: a plan without history."""
        path = f"{self.root}/{label}-{self.n}"
        self.n += 1
        schema = df.schema
        write_once(self.spark, lambda: df.write.parquet(path))
        self.paths[label] = path
        return self.spark.read.schema(schema).parquet(path)

    def put_counted(self, df: DataFrame, label: str) -> tuple[DataFrame, int]:
        """Like put, with the number of rows, counted while they are written."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
        return out, seen.get["n"]

    def done(self, *labels: str) -> None:
        """Removes tables that nothing reads any more."""
        for x in labels:
            if x in self.paths:
                self.drop(self.paths.pop(x))

    def drop(self, path: str) -> None:
        remove(self.spark, path)

    def replace(self, df: DataFrame, label: str) -> DataFrame:
        """Like put, then removes the table that had this label before (df may read it)."""
        old = self.paths.get(label)
        out = self.put(df, label)
        if old:
            self.drop(old)
        return out

    def replace_counted(self, df: DataFrame, label: str) -> tuple[DataFrame, int]:
        """Like replace, with the number of rows."""
        old = self.paths.get(label)
        out = self.put_counted(df, label)
        if old:
            self.drop(old)
        return out


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    f = Path(tempfile.mkdtemp(prefix="corpuslens-ship-")) / "corpuslens.zip"  # the driver serves it from here
    f.write_bytes(raw.getvalue())
    sc.addPyFile(str(f))
    _SHIPPED.add(sc.applicationId)
