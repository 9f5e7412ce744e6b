from datetime import datetime

from corpuslens.llm.consolidate import hash_to_min, links_of_groups
from corpuslens.llm.survivors import best_members, survivors
from corpuslens.operators.components import components

PAIR = "a string, b string, v int, u int, m int, id int"


def test_hash_to_min(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)]
    rows = [("b", "a"), ("b", "c"), ("b", "c"), ("c", "b"), ("x", "x"), (None, "y"), ("p", None), ("q", "r"), *chain]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], PAIR)
    got = {r.id: r.group_key for r in hash_to_min(df).collect()}
    want = {r.id: r.label for r in components(df.select("a", "b").filter("a != b")).collect()}
    assert got == want and got["c"] == "a" and got["n030"] == "n000" and "x" not in got and "y" not in got
    assert hash_to_min(df.limit(0)).count() == 0


def test_star_of_a_hot_group(spark):
    df = spark.createDataFrame([("m0000", f"m{i:04}") for i in range(1, 1500)] + [("m0000", "a")], "a string, b string")
    got = hash_to_min(df).collect()
    assert len(got) == 1501 and {r.group_key for r in got} == {"a"}


def test_links_of_groups(spark):
    rows = [("a", ["a", "b", "b", None]), ("c", ["c"]), (None, ["d", "e"]), ("f", None), ("g", []), ("h", ["i"])]
    df = spark.createDataFrame(rows, "canonical_chunk_id string, member_chunk_ids array<string>")
    got = {frozenset((r.a, r.b)) for r in links_of_groups(df, "canonical_chunk_id", "member_chunk_ids").collect()}
    assert got == {frozenset("ab"), frozenset("de"), frozenset("hi")}


CH = ("chunk_id string, text string, resolved_timestamp timestamp_ntz, last_seen_by_pulse timestamp_ntz, deleted_at timestamp_ntz, "
      "timestamp_source string, store_id string, time_us string, group_id int")


def test_survivors(spark):
    t = lambda d: datetime(2024, 1, d)
    seen, none = t(20), None
    ch = spark.createDataFrame([
        ("a", "short", t(5), seen, none, "first_seen", "s1", "clash", 9),
        ("b", " longer text \n", t(3), seen, none, "metadata_field", none, "clash", 9),
        ("c", "longer text", t(3), seen, none, "metadata_field", "s2", "clash", 9),
        ("d", "the longest text of them", datetime(1970, 1, 1), seen, none, none, "s3", "clash", 9),
        ("e", "the longest text of theN", t(25), seen, none, none, "s3", "clash", 9),
        ("f", "deleted and very very long", t(19), seen, t(19), none, "s3", "clash", 9),
        ("g", " \n", t(19), seen, none, none, "s3", "clash", 9), ("h", none, t(19), seen, none, none, "s3", "clash", 9)], CH)
    g = spark.createDataFrame([
        (1, "a", ["a", "b", "c", "c", "zz", None]), (1, "a", ["b"]), (2, "d", ["d", "e", "f"]), (3, "f", ["g", "h"]), (4, None, ["c", "b"]), (5, "d", ["a"]), (6, "a", None)],
        "group_id int, canonical_chunk_id string, member_chunk_ids array<string>")
    got = {r.group_id: (r.ts_chunk_id, r.text_chunk_id) for r in best_members(g, ch).collect()}
    assert got == {1: ("a", "b"), 4: ("b", "b"), 5: ("a", "d"), 6: ("a", "a")}
    s = {r.group_id: r for r in survivors(g, ch, ["store_id", "text", "resolved_timestamp"]).collect()}
    assert s[1].store_id == "s2" and s[1].store_id_chunk_id == "c" and s[1].text_chunk_id == "b" and s[1].n_members == 3
    assert s[2].resolved_timestamp is None and s[2].resolved_timestamp_chunk_id is None and s[2].text_chunk_id == "d" and 3 not in s  # both times count as missing
    assert best_members(g.limit(0), ch).count() == 0 and best_members(g, ch.limit(0)).count() == 0
