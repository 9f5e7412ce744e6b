"""New batches against all accepted history: multi-key sorted-neighbourhood runs that last.

Every record has several sort keys, the list values of its sketch. The history is a folder: runs
of (key, n, id, union places), cut into hash ranges of the key and sorted by (key, n) inside each
range, n being the record's number of shingles; the texts of the accepted records, cut and sorted
by id; the count table that orders the keys; and a numbered state that names them. ``History.open``
takes the folder up again, in this process or another, without reading the history.

A batch is sketched once, sorted once and merged with every run. Around each new record the window
is what lies next to it in the run: the same key, and sizes that allow the threshold (n * t to
n / t); inside the window the union places decide, and what passes is verified on whole texts. A
window is as wide as that rule makes it, not a fixed number of neighbours, so nothing is lost. No
run is shuffled, sorted or sketched again, and a batch with at most FEW keys reads only the pages
of the runs that its keys lie in, and of the texts that its candidates lie in (files are sorted and
their pages short), if these pages are less than the table. However many ranges a table has, it is
one scan in the plan. Accepted records become a new run; when there are more than
``max_runs``, runs of like size are compacted into one (a run more than four times as large as all
smaller ones together is left alone).

Inside a batch the order decides: a record is a case if it resembles the history or an earlier
record that is itself no case. Of records with the same shingle set only the first can be
accepted, so the others need no comparison. The rest is decided in rounds on what is undecided:
whoever has no undecided earlier neighbour is decided by the accepted ones among them. That takes
as many rounds as the longest chain of undecided neighbours in ascending order.

Defined results: null, blank and short texts resemble nothing and are accepted (they hold no
keys); a content hash is never used as proof; ties of the order fall to the record's id; empty
batches and an empty history work; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.near import MIN_WORDS, WORDS
from corpuslens.llm.sketch import count_cells, exact_pairs, lists, may_resemble, sketches
from corpuslens.session import Stage, remove, write_once

RANGE_ROWS = 1_000_000  # rows of a range of a run
TEXT_ROWS = 200_000  # texts of a range
PASSES = 3  # a large run is written in so many parts, so that only one of them lies in shuffle files
FEW = 1_000  # keys or ids that are looked up page by page; the driver holds so many of a batch at most
PAGE = {"key": 1_000, "id": 100}  # rows of a page
SETTINGS = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",  # one file a range: its order holds
    "spark.sql.parquet.pushdown.inFilterThreshold": "64",
}


class History:
    def __init__(self, spark: SparkSession, path: str, threshold: float, max_runs: int = 6, words: int = WORDS, min_words: int = MIN_WORDS):
        """A new history in an empty folder that all executors share."""
        self.spark, self.path, self.max_runs = spark, path.rstrip("/"), max_runs
        self.state = {"threshold": threshold, "words": words, "min_words": min_words, "version": 0, "runs": [], "texts": [], "records": 0}
        self.counts = b""

    @classmethod
    def open(cls, spark: SparkSession, path: str, max_runs: int = 6) -> History:
        """The history that was kept in the folder, as its last finished step left it."""
        rows = spark.read.parquet(f"{path.rstrip('/')}/state").orderBy(F.desc("v")).limit(1).collect()
        s = json.loads(rows[0]["state"])
        h = cls(spark, path, s["threshold"], max_runs, s["words"], s["min_words"])
        h.state = s
        h.counts = bytes(spark.read.parquet(f"{h.path}/counts").first()["counts"])
        for t in s["runs"]:
            h._register(t, "key bigint, n int, id bigint, lo bigint, hi bigint, place int", "key", "key, n")
        for t in s["texts"]:
            h._register(t, "id bigint, text string, place int", "id", "id")
        return h

    def _register(self, t: dict, columns: str, by: str, order: str) -> None:
        self.spark.sql(f"create table if not exists {t['name']} ({columns}) using parquet clustered by ({by}) sorted by ({order}) "
                       f"into {t['ranges']} buckets location '{self.path}/{t['name']}'")

    def _commit(self) -> None:
        self.state["version"] += 1
        row = self.spark.createDataFrame([(json.dumps(self.state),)], "state string").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/state/v={self.state['version']}")

    def _count(self, texts: DataFrame) -> None:
        self.counts = count_cells(texts, "text", self.state["words"], self.state["min_words"])
        self.spark.createDataFrame([(bytearray(self.counts),)], "counts binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts")

    def _sketch(self, texts: DataFrame) -> DataFrame:
        s = self.state
        return sketches(texts, "id", "text", self.counts, s["threshold"], s["words"], s["min_words"])

    def _ranges(self, rows: int, each: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))

    def _write(self, df: DataFrame, kind: str, by: str, order: list[str], ranges: int, passes: int = 1, once: bool = False) -> dict:
        """Writes df (hash-ranged by a BIGINT) as a table with one sorted file a range; once: one row of each ``by``.

        Each row has the number of its range, so that a reader can ask each file for its own values.
        """
        name = f"{kind}_{uuid.uuid4().hex}"
        for p in range(passes):
            part = df if passes == 1 else df.filter(F.pmod(F.pmod(F.hash(by), F.lit(ranges)), F.lit(passes)) == p)
            part = part.repartition(ranges, by)
            part = (part.dropDuplicates([by]) if once else part).withColumn("place", F.pmod(F.hash(by), F.lit(ranges)))
            w = part.write.bucketBy(ranges, by).sortBy(*order).option("path", f"{self.path}/{name}").option(
                "parquet.page.row.count.limit", str(PAGE[by])).option("compression", "zstd")
            write_once(self.spark, lambda w=w, p=p: w.mode("append" if p else "errorifexists").saveAsTable(name))
        return {"name": name, "ranges": ranges, "placed": True}

    def _add_run(self, rows: DataFrame, n: int, passes: int = 1) -> None:
        """rows: (key, n, id, lo, hi)."""
        t = self._write(rows.select("key", "n", "id", "lo", "hi"), "run", "key", ["key", "n"], self._ranges(n, RANGE_ROWS), passes)
        self.state["runs"].append(t | {"rows": n})

    def _add_texts(self, texts: DataFrame, n: int) -> None:
        self.state["texts"].append(self._write(texts.select("id", "text"), "texts", "id", ["id"], self._ranges(n, TEXT_ROWS), once=True) | {"rows": n})

    def _merged(self, kind: str) -> list[dict]:
        """Tables of like size that are to become one; none if there are few."""
        tables = sorted(self.state[kind], key=lambda t: t["rows"])
        if len(tables) <= self.max_runs:
            return []
        take, total = [], 0
        for t in tables:
            if len(take) >= 2 and t["rows"] > 4 * total:
                break
            take.append(t)
            total += t["rows"]
        return take

    def compact(self) -> None:
        """Merges runs, and texts, of like size."""
        for kind, add in (("runs", self._add_run), ("texts", self._add_texts)):
            old = self._merged(kind)
            if not old:
                continue
            rows = self.spark.table(old[0]["name"])
            for t in old[1:]:
                rows = rows.unionByName(self.spark.table(t["name"]))
            self.state[kind] = [t for t in self.state[kind] if t not in old]
            add(rows, sum(t["rows"] for t in old))
            self._commit()
            for t in old:
                self.spark.sql(f"drop table {t['name']}")
                remove(self.spark, f"{self.path}/{t['name']}")

    def close(self) -> None:
        """Forgets the tables' names; the folder stays."""
        for t in self.state["runs"] + self.state["texts"]:
            self.spark.sql(f"drop table if exists {t['name']}")

    @staticmethod
    def _postings(sk: DataFrame) -> DataFrame:
        n = F.col("hi").bitwiseAND(F.lit(65535)).cast("int")
        return lists(sk, "id", "set_a", "set_b").withColumn("n", n).withColumnRenamed("value", "key")

    def load(self, texts: DataFrame) -> None:
        """The accepted past: (id BIGINT, text); becomes the first run."""
        self._count(texts)
        stage = Stage(self.spark, "history-load")
        sk = stage.put(self._sketch(texts), "sketches")
        n = sk.agg(F.sum(F.greatest(F.size("vals"), F.lit(0)))).first()[0] or 0
        # Of copies one record is enough: the smallest id.
        one = self._postings(sk).groupBy("key", "n", "set_a", "set_b", "lo", "hi").agg(F.min("id").alias("id"))
        self._add_run(one, n, PASSES if n > RANGE_ROWS else 1)
        self.state["records"] = sk.count()
        stage.done("sketches")
        self._add_texts(texts.filter("text is not null"), self.state["records"])
        self._commit()

    @staticmethod
    def _few(wanted: DataFrame, column: str) -> list[tuple[int, int]] | None:
        """(value, hash) of each wanted value; None if there are more than FEW."""
        rows = wanted.select(column).distinct().select(column, F.hash(column)).limit(FEW + 1).collect()
        return [tuple(r) for r in rows] if len(rows) <= FEW else None

    def _some(self, t: dict, column: str, few: list[tuple[int, int]] | None) -> DataFrame:
        """The table t, or its rows with a wanted value if their pages are less than the table: one scan, each range for its own values."""
        table = self.spark.table(t["name"])
        if few is None or not t.get("placed") or len(few) * PAGE[column] >= t["rows"]:
            return table
        own: dict[int, list[int]] = {}
        for value, h in few:
            own.setdefault(h % t["ranges"], []).append(value)
        parts = [(F.col("place") == r) & F.col(column).isin(x[i : i + 64]) for r, x in sorted(own.items()) for i in range(0, len(x), 64)]
        while len(parts) > 1:  # a balanced tree: the reader walks it recursively
            parts = [reduce(Column.__or__, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return table.filter(parts[0]) if parts else table.limit(0)

    def _window(self, new: DataFrame, run: DataFrame) -> DataFrame:
        """(id_n, id_h): the records of a run in the windows around the new ones that may resemble them."""
        t = self.state["threshold"]
        h = run.select("key", F.col("n").alias("size_h"), F.col("id").alias("id_h"), F.col("lo").alias("lo_h"), F.col("hi").alias("hi_h"))
        near = (F.col("size_h") >= F.col("size_n") * t - 1e-6) & (F.col("size_h") * t <= F.col("size_n") + 1e-6)
        return h.join(new, "key").filter((near | (F.greatest("size_h", "size_n") == 65535)) & may_resemble("n", "h", t)).select("id_n", "id_h")

    def accept(self, batch: DataFrame) -> DataFrame:
        """(id) of the cases of a batch (id BIGINT, o1, o2: order, text); the others are accepted."""
        before = {k: self.spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            return self._accept(batch)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def _accept(self, batch: DataFrame) -> DataFrame:
        s = self.state
        if not self.counts:
            self._count(batch)
        stage, order = Stage(self.spark, "history"), ["o1", "o2", "id"]
        sk = stage.put(self._sketch(batch).join(batch.select(*order), "id"), "sketches")
        firsts = stage.put(sk.groupBy("set_a", "set_b").agg(F.min(F.struct(*order)).alias("r")).select("set_a", "set_b", "r.*"), "firsts")
        repeats = sk.select("id").join(firsts.select("id"), "id", "left_anti")
        own = self._postings(sk).drop("id").distinct().join(firsts.select("set_a", "set_b", "id"), ["set_a", "set_b"]).drop("set_a", "set_b")
        own = stage.put(own, "new")
        new = own.select("key", F.col("n").alias("size_n"), F.col("id").alias("id_n"), F.col("lo").alias("lo_n"), F.col("hi").alias("hi_n"))
        both = self._window(new, own).filter("id_h < id_n").withColumn("past", F.lit(False))
        values = self._few(own, "key")
        for r in s["runs"]:
            both = both.unionByName(self._window(new, self._some(r, "key", values)).withColumn("past", F.lit(True)))
        cand = stage.put(both.distinct(), "candidates")
        past = stage.put(cand.filter("past").select(F.col("id_h").alias("id")).distinct(), "past")
        known = batch.select(F.col("id").alias("id_h"), F.col("text").alias("text_h"), F.lit(False).alias("past"))
        ids = self._few(past, "id")
        for t in s["texts"]:  # ranged by id: the texts don't move
            x = self._some(t, "id", ids).join(past, "id", "left_semi")
            known = known.unionByName(x.select(F.col("id").alias("id_h"), F.col("text").alias("text_h"), F.lit(True).alias("past")))
        new_text = batch.join(cand.select(F.col("id_n").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("id_n"), F.col("text").alias("text_n"))
        pair = cand.join(known, ["id_h", "past"]).join(new_text, "id_n")
        ok = stage.put(exact_pairs(pair, "text_n", "text_h", s["threshold"], s["words"], s["min_words"]).select("id_n", "id_h", "past"), "verified")
        hist = ok.filter("past").select(F.col("id_n").alias("id")).distinct()
        at = firsts.select("id", F.struct(*order).alias("pos"))
        inner = ok.filter("not past").select("id_n", "id_h").join(at.select(F.col("id").alias("id_n"), F.col("pos").alias("pn")), "id_n").join(
            at.select(F.col("id").alias("id_h"), F.col("pos").alias("ph")), "id_h")
        inner = inner.select(
            F.when(F.col("pn") < F.col("ph"), F.col("id_n")).otherwise(F.col("id_h")).alias("a"),
            F.when(F.col("pn") < F.col("ph"), F.col("id_h")).otherwise(F.col("id_n")).alias("b"))
        inner = inner.join(hist.select(F.col("id").alias("a")), "a", "left_anti").join(hist.select(F.col("id").alias("b")), "b", "left_anti")
        cases = stage.put(hist.unionByName(repeats).unionByName(self._in_order(inner, stage)).distinct(), "cases")
        fresh = firsts.select("id").join(cases, "id", "left_anti")
        n, rows = fresh.count(), 0
        if n:
            keys = own.join(fresh, "id", "left_semi")
            rows = keys.count()
            self._add_run(keys, rows)
            self._add_texts(batch.join(fresh, "id", "left_semi"), n)
        s["records"] += n
        self._commit()
        stage.done("sketches", "firsts", "new", "candidates", "past", "verified")
        self.compact()
        return cases

    def _in_order(self, pairs: DataFrame, stage: Stage) -> DataFrame:
        """(id) of the cases among pairs (a earlier, b later), each round on the pairs still undecided."""
        left = stage.put(pairs.distinct(), "order")
        cases = left.select(F.col("b").alias("id")).limit(0)
        while not left.isEmpty():
            later = left.select(F.col("b").alias("a")).distinct()
            free = left.join(later, "a", "left_anti").select("a").distinct()  # no undecided earlier neighbour: accepted
            hit = stage.put(left.join(free, "a", "left_semi").select(F.col("b").alias("id")).distinct(), f"hit{stage.n}")
            cases = cases.unionByName(hit)
            gone = lambda c, hit=hit: hit.select(F.col("id").alias(c))
            left = stage.replace(left.join(free, "a", "left_anti").join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti"), "order")
        return cases


def batches_of(intake: DataFrame, idc: str, order: list[str], text: str) -> DataFrame:
    """(id, o1, o2, text, rec): rec is the record's own id."""
    o = [F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in order]
    return intake.filter(F.col(idc).isNotNull()).select(
        F.xxhash64(F.lit("new"), F.col(idc)).alias("id"), o[0].alias("o1"), o[1].alias("o2"), F.col(text).alias("text"), F.col(idc).alias("rec"))


def groups_of(batches: DataFrame, least: int) -> list[tuple[int, int]]:
    """Consecutive batches (first, last o1) that are merged at a time: at least so many records together.

    A merge passes over the keys of the history, so small batches share one; the cases are the same.
    """
    out, first, n = [], None, 0
    for r in batches.groupBy("o1").count().orderBy("o1").collect():  # one row a batch
        first = r["o1"] if first is None else first
        n += r["count"]
        if n >= least:
            out.append((first, r["o1"]))
            first, n = None, 0
    if first is not None:
        out.append((first, r["o1"]))
    return out
