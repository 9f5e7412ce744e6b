"""Near-duplicate texts: bottom-k sketches, inverted lists, union estimate, exact Jaccard.

1. Texts are sketched once, into a staged table. Texts with the same shingle set are one vertex, so
   a text that is repeated a million times is in the inverted lists once.
2. Each list value of a sketch (see ``sketch``: the rare end of the bottom-k sketch, long enough
   that no pair is missed) becomes a row (value, set, union places). Rows with the same value are
   joined; inside the join, where no pair has been written yet, sizes and the union estimate
   reject nearly all meetings. Only what passes is shuffled.
3. Distinct candidates are verified on the whole texts.

Defined results: null, empty and short texts resemble nothing; copies resemble each other with 1;
ids are expected to be distinct (rows that repeat an id and its text change nothing); null ids
are ignored; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.sketch import can_lead, count_cells, exact_pairs, lists, may_resemble, sketches
from corpuslens.session import Stage

WORDS, MIN_WORDS = 3, 12
PASSES = 2  # the lists are joined in so many parts, so that only one of them lies in shuffle files


def keyed(df: DataFrame, idc: str, text: str) -> DataFrame:
    """(id BIGINT, name, text): id is a 64-bit hash of the record's name."""
    return df.filter(F.col(idc).isNotNull()).select(F.xxhash64(idc).alias("id"), F.col(idc).alias("name"), F.col(text).alias("text"))


def candidates(sk: DataFrame, threshold: float, part: int) -> DataFrame:
    """Distinct (set_1, set_2) that meet in a list value of one part and pass ``may_resemble``; set_1 has no more shingles.

    Rows that can't belong to the smaller text stand on one side only: a phrase in a third of all
    texts that is too small a part of each of them meets nobody.
    """
    p = lists(sk, "set_a").filter(F.pmod("value", F.lit(PASSES)) == part).repartition("value").distinct()
    side = lambda s: p.select("value", F.col("set_a").alias(f"set_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    n1, n2 = (F.col(f"hi_{s}").bitwiseAND(F.lit(65535)) for s in "12")
    j = side("1").filter(can_lead("hi_1")).join(side("2"), "value")
    smaller = (n1 < n2) | (n1 == n2) & (F.col("set_1") < F.col("set_2"))
    return j.filter(smaller & may_resemble("1", "2", threshold)).select("set_1", "set_2").distinct()


class NearDuplicates:
    """The parts of one run: sets, copies and verified pairs of representatives."""

    def __init__(self, df: DataFrame, idc: str, text: str, threshold: float, words: int = WORDS, min_words: int = MIN_WORDS):
        stage = Stage(df.sparkSession, "near")
        t = keyed(df, idc, text)
        counts = count_cells(t, "text", words, min_words)
        sk = stage.put(sketches(t, "id", "text", counts, threshold, words, min_words), "sketches")
        sets = sk.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
        self.sets = stage.put(sets, "sets")
        found = [stage.put(candidates(sk, threshold, p), f"candidates{p}") for p in range(PASSES)]
        cand = reduce(DataFrame.unionByName, found).distinct()
        member = sk.select("id", "set_a", "set_b").join(self.sets.filter("copies > 1").select("set_a", "set_b", "rep"), ["set_a", "set_b"])
        self._copies = stage.put(member.select("id", "rep"), "members")
        stage.done("sketches")
        rep = lambda s: self.sets.select(F.col("set_a").alias(f"set_{s}"), F.col("rep").alias(f"id_{s}"))
        ids = stage.put(cand.join(rep("1"), "set_1").join(rep("2"), "set_2").select("id_1", "id_2"), "ids")
        need = ids.select(F.explode(F.array("id_1", "id_2")).alias("id")).distinct()
        texts = t.join(need, "id", "left_semi").dropDuplicates(["id"])
        full = lambda s: texts.select(F.col("id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"), F.col("text").alias(f"text_{s}"))
        pair = ids.join(full("1"), "id_1").join(full("2"), "id_2")
        self.pairs = stage.put(exact_pairs(pair, "text_1", "text_2", threshold, words, min_words), "pairs")
        stage.done("ids", *[f"candidates{p}" for p in range(PASSES)])
        self._names, self._stage, self._has = t.select("id", "name"), stage, None

    @property
    def copies(self) -> DataFrame:
        """(rep, name): all members of copy groups of two or more, the representative included."""
        if self._has is None:
            c = self._copies.join(self._names, "id").select("rep", "name").distinct()
            self._has = self._stage.put(c, "copies")
        return self._has

    def all_pairs(self) -> DataFrame:
        """(name_a, name_b), name_a < name_b: every pair, copies expanded."""
        c = self.copies
        other = lambda s: c.select(F.col("rep").alias(f"id_{s}"), F.col("name").alias(f"copy_{s}"))
        p = self.pairs.join(other("1"), "id_1", "left").join(other("2"), "id_2", "left").select(
            F.coalesce("copy_1", "name_1").alias("x"), F.coalesce("copy_2", "name_2").alias("y"))
        inner = c.select("rep", F.col("name").alias("x")).join(c.select("rep", F.col("name").alias("y")), "rep").filter("x < y").select("x", "y")
        return p.unionByName(inner).select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))

    def links(self) -> DataFrame:
        """(a, b): the pairs of representatives and a star around the representative of each copy group."""
        lead = self.copies.join(self._names.select(F.col("id").alias("rep"), F.col("name").alias("a")).distinct(), "rep")
        star = lead.filter("a != name").select("a", F.col("name").alias("b"))
        return self.pairs.select(F.col("name_1").alias("a"), F.col("name_2").alias("b")).unionByName(star)
