import random
import re

import numpy as np
import pytest

from corpuslens.llm.consolidate import hash_to_min
from pyspark.sql import functions as F

from corpuslens.llm import history
from corpuslens.llm import sketch as S
from corpuslens.llm.history import History, batches_of, groups_of
from corpuslens.llm.mixing import mix
from corpuslens.llm.near import NearDuplicates
from corpuslens.llm.tokens import DEFAULT_VOCABULARY, ByteBpe, count_tokens, decode, encode

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]


def sentence(n):
    return [rng.choice(WORDS) for _ in range(n)]


def edited(w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
    return w


def sets(t):
    w = re.findall(r"\w+", t.lower()) if t else []
    return set(zip(w, w[1:], w[2:])) if len(w) >= 12 else set()


def sim(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def corpus():
    out = []
    for _ in range(40):
        w = sentence(60)
        out += [" ".join(edited(w, k)) for k in (0, 1, 2, 4, 7)]
    out += [out[0]] * 6 + [out[0].upper(), out[1].replace(" ", ", ")]
    out += [None, "", " ", "too short to count", "..."] + ["same words " * 8] * 3 + [" ".join(sentence(4000)), "é" * 3000 + " ünï " * 40]
    return out


def test_near_duplicates(spark):
    t = corpus()
    df = spark.createDataFrame([(f"c{i:04}", x, 1, 2, "z") for i, x in enumerate(t)] + [(None, t[0], 1, 2, "z")], "cid string, body string, id int, lo int, name string")
    n = NearDuplicates(df, "cid", "body", 0.7)
    got = [(r.name_a, r.name_b) for r in n.all_pairs().collect()]
    s = [sets(x) for x in t]
    want = {(f"c{i:04}", f"c{j:04}") for i in range(len(t)) for j in range(i + 1, len(t)) if sim(s[i], s[j]) >= 0.7}
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: r.group_key for r in hash_to_min(n.links()).collect()}
    assert all(groups[a] == groups[b] for a, b in want) and set(groups) == {x for p in want for x in p}


def family(n, words=200, edits=4, shared=0):
    """n copies of one text, each with its own edits: every shared shingle is frequent, every edit rare."""
    r = random.Random(n)
    base, out = [f"f{r.randrange(5000)}" for _ in range(words)], []
    for i in range(n):
        w = list(base)
        for j in r.sample(range(words), edits):
            w[j] = f"own{i}x{j}"
        out.append(" ".join(BOILERPLATE[:shared] + w))
    return out


BOILERPLATE = [f"boiler{i}" for i in range(22)]


def wanted(s, min_sim=0.7):
    return {(f"c{i:05}", f"c{j:05}") for i in range(len(s)) for j in range(i + 1, len(s)) if sim(s[i], s[j]) >= min_sim}


@pytest.mark.parametrize("n", [20, 80, 400])
def test_near_duplicates_of_a_large_family(spark, n):
    t = family(n, edits=5, shared=22) + [" ".join(BOILERPLATE + sentence(50)) for _ in range(60)]
    found = NearDuplicates(spark.createDataFrame([(f"c{i:05}", x) for i, x in enumerate(t)], "cid string, body string"), "cid", "body", 0.7)
    want = wanted([sets(x) for x in t])
    assert len(want) > n and {(r.name_a, r.name_b) for r in found.all_pairs().collect()} == want


def test_meetings_pass_the_filters():
    """Every pair at the threshold meets in a list with room for what it shares and few places that differ."""
    r = random.Random(11)
    for n in (12, 30, 90, 140, 700):
        t = []
        for _ in range(40):
            base = [f"g{r.randrange(10**6)}" for _ in range(n)]
            t += [" ".join(edited(base, k)) for k in (0, max(1, n // 40), n // 18)]
        keys = S.shingle_keys(t, 3, 12)
        doc, at, size = S._starts(keys)
        least, h = S.least_shared(0.7, S.KEEP), keys & S._HASH
        lo, hi = S.union_places(keys, doc, at, size)
        bits = [[(int(x) >> (2 * p)) & 3 for p in range(32)] + [(int(y) >> (24 + 2 * p)) & 3 for p in range(20)] for x, y in zip(lo, hi)]
        low = [set(h[a : a + min(m, S.KEEP)].tolist()) for a, m in zip(at, size)]
        pairs = [(i, j) for i in range(len(t)) for j in range(i) if sim(sets(t[i]), sets(t[j])) >= 0.7]
        assert len(pairs) >= 40
        for i, j in pairs:
            assert len(low[i] & low[j]) >= max(least[0, min(x, least.shape[1] - 1)] for x in (size[i], size[j]))
            assert len(low[i] & low[j]) >= least[1, min(size[i], size[j], least.shape[1] - 1)]
            assert sum(x != y for x, y in zip(bits[i], bits[j])) <= S.most_different(0.7)


def test_boilerplate_leads_no_list(spark):
    """Texts of three quarters boilerplate are no pairs, and their common values have no row that can lead."""
    r = random.Random(5)
    base = [f"common{i}" for i in range(75)]
    t = [" ".join(base + [f"own{r.randrange(10**7)}" for _ in range(27)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(t)), "id long, text string")
    counts = S.count_cells(df, "text", 3, 12)
    rows = S.lists(S.sketches(df, "id", "text", counts, 0.7, 3, 12), "set_a")
    sizes = rows.groupBy("value").agg(F.count("*").alias("n"), F.count_if(S.can_lead("hi")).alias("lead"))
    assert sizes.filter("n > 100").count() > 0 and sizes.filter("n > 100 and lead > 0").count() == 0


def test_shingles_of_any_script():
    texts = ["Ünï Tést ΣΊΣΥΦΟΣ ΣΑΣ İstanbul straße ⅷ x² 日本語 テキスト naïve", None, "", "a_b 1,5 c--d\u200be f\u0301g h i j k l m n", "x " * 40, "word " * 300_000 + "end of it"]
    keys = S.shingle_keys(texts, 3, 1)
    n = dict(zip(*np.unique(keys >> np.uint64(48), return_counts=True)))
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", t.lower()) if t else []
        assert n.get(i, 0) == len(set(zip(w, w[1:], w[2:])))
    long = "zero " * 3 + "one two three " * 400_000
    assert len(S.word_hashes([long])[0]) == 1_200_003 and len(S.shingle_keys([long], 3, 1)) == 7 - 1


@pytest.mark.parametrize("n", [10, 40, 300])
def test_history_of_a_large_family(spark, tmp_path, n):
    t = family(n + 10, edits=5, shared=22)
    other = [" ".join(BOILERPLATE + sentence(50)) for _ in range(40)]
    h = History(spark, str(tmp_path / "h"), 0.7)
    h.load(spark.createDataFrame(list(enumerate(t[:n] + other[:20])), "id long, text string"))
    b = batches_of(spark.createDataFrame([(i, 0, x) for i, x in enumerate(t[n:] + other[20:])], "iid long, batch int, text string"), "iid", ["batch", "iid"], "text")
    got = {r.rec for r in b.join(h.accept(b.drop("rec")), "id").collect()}
    assert got == set(range(10))
    h.close()


def test_history_is_taken_up_again(spark, tmp_path):
    path = str(tmp_path / "h")
    old, new = [" ".join(sentence(40)) for _ in range(12)], [" ".join(sentence(40)) for _ in range(6)]
    h = History(spark, path, 0.7)
    h.load(spark.createDataFrame(list(enumerate(old)), "id long, text string"))
    b = lambda rows: batches_of(spark.createDataFrame(rows, "iid long, batch int, text string"), "iid", ["batch", "iid"], "text")
    assert h.accept(b([(i, 0, x) for i, x in enumerate(new)]).drop("rec")).count() == 0
    h.close()
    h = History.open(spark, path, max_runs=1)
    assert h.state["records"] == 18 and len(h.state["runs"]) == 2
    again = b([(10, 1, " ".join(edited(old[3].split(), 1))), (11, 1, new[2]), (12, 1, " ".join(sentence(40)))])
    assert {r.rec for r in again.join(h.accept(again.drop("rec")), "id").collect()} == {10, 11}
    assert len(h.state["runs"]) == 1 and len(h.state["texts"]) == 1  # compacted
    h.close()
    h = History.open(spark, path)
    more = b([(20, 2, " ".join(edited(old[5].split(), 2))), (21, 2, None), (22, 2, new[0].upper())])
    assert {r.rec for r in more.join(h.accept(more.drop("rec")), "id").collect()} == {20, 22}
    h.close()


@pytest.mark.parametrize("page", [4, 1_000])
def test_history_reads_each_table_in_one_scan(spark, tmp_path, monkeypatch, page):
    """Few keys, looked up page by page or not: a plan has no more scans and joins than tables, however many ranges those have."""
    plans, put = [], history.Stage.put
    monkeypatch.setattr(history.Stage, "put", lambda self, df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or put(self, df, label))
    monkeypatch.setattr(history, "PAGE", {"key": page, "id": page})
    monkeypatch.setattr(History, "_ranges", lambda *_: 24)
    old = [" ".join(sentence(40)) for _ in range(400)]
    h = History(spark, str(tmp_path / "h"), 0.7)
    h.load(spark.createDataFrame([(i * 7919, x) for i, x in enumerate(old)], "id long, text string"))
    new, want = [], set()
    for b in range(3):
        new += [(4 * b, b, " ".join(edited(old[b].split(), 1))), (4 * b + 1, b, old[b + 90]), (4 * b + 2, b, " ".join(sentence(40))), (4 * b + 3, b, new[2][2] if b else None)]
        want |= {4 * b, 4 * b + 1} | ({4 * b + 3} if b else set())
    n, got = batches_of(spark.createDataFrame(new, "iid long, batch int, text string"), "iid", ["batch", "iid"], "text"), set()
    for b in range(3):
        got |= {r.rec for r in n.join(h.accept(n.filter(n.o1 == b).drop("rec")), "id").collect()}
    assert got == want
    for label, plan in plans:
        if label in ("candidates", "verified"):
            assert plan.count("Relation ") <= 12 and plan.count("Join ") <= 8, plan
    looked = [plan.count("(place#") for label, plan in plans if label in ("candidates", "verified")]
    assert (max(looked) > 0) == (page == 4)
    h.close()


def test_history_of_the_form_before_is_read_whole(spark, tmp_path):
    """Tables without the number of the range in their rows."""
    old = [" ".join(sentence(40)) for _ in range(12)]
    h = History(spark, str(tmp_path / "h"), 0.7)
    h._write = lambda *a, w=h._write, **k: {x: y for x, y in w(*a, **k).items() if x != "placed"}
    h.load(spark.createDataFrame(list(enumerate(old)), "id long, text string"))
    n = batches_of(spark.createDataFrame([(1, 0, old[3]), (2, 0, " ".join(sentence(40)))], "iid long, batch int, text string"), "iid", ["batch", "iid"], "text")
    assert {r.rec for r in n.join(h.accept(n.drop("rec")), "id").collect()} == {1}
    h.close()


def test_history_without_a_past(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), 0.7)
    chain = [list(f"w{i}" for i in range(60))]
    for i in range(8):
        chain.append(chain[-1][:])
        chain[-1][7 * i + 2] = f"new{i}"
    rows = [(i, 0, " ".join(w)) for i, w in enumerate(chain)]
    b = batches_of(spark.createDataFrame(rows, "iid long, batch int, text string"), "iid", ["batch", "iid"], "text")
    kept, want = [], set()
    for i, _, t in rows:
        if any(sim(sets(t), k) >= 0.7 for k in kept):
            want.add(i)
        else:
            kept.append(sets(t))
    assert {r.rec for r in b.join(h.accept(b.drop("rec")), "id").collect()} == want and 0 < len(want) < 8
    h.close()


def test_batches_are_merged_together(spark):
    b = spark.createDataFrame([(i // 10,) for i in range(100)] + [(5000,)] * 3, "o1 long")
    assert groups_of(b, 25) == [(0, 2), (3, 5), (6, 8), (9, 5000)] and groups_of(b.limit(0), 5) == []


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "cid string, body string")
    assert NearDuplicates(df, "cid", "body", 0.7).all_pairs().count() == 0
    df = spark.createDataFrame([("a", None), ("b", "x")], "cid string, body string")
    assert NearDuplicates(df, "cid", "body", 0.7).all_pairs().count() == 0


@pytest.mark.parametrize("runs", [1, 4])
def test_history(spark, runs, tmp_path):
    old = [" ".join(sentence(40)) for _ in range(30)] + [None, "", "x y"]
    new = []
    for b in range(3):
        for _ in range(6):
            base = sentence(40)
            new += [(b, " ".join(edited(base, k))) for k in (0, 2, 3)]
        new += [(b, " ".join(edited(old[b].split(), 2))), (b, old[b + 5]), (b, None), (b, ""), (b, new[0][1])]
    rows = [(i, b, t, "hash", 5) for i, (b, t) in enumerate(new)]
    rng.shuffle(rows)
    h = History(spark, str(tmp_path / "h"), 0.7, max_runs=runs)
    o = spark.createDataFrame([(i - 1000, t) for i, t in enumerate(old)], "id long, text string")
    h.load(o)
    n = batches_of(spark.createDataFrame(rows, "iid long, batch int, text string, content_hash string, id int"), "iid", ["batch", "iid"], "text")
    got = set()
    for b in range(3):
        c = h.accept(n.filter(n.o1 == b).drop("rec"))
        got |= {r.rec for r in n.join(c, "id").collect()}
    assert h.accept(n.limit(0).drop("rec")).count() == 0
    h.close()
    kept, want = [sets(t) for t in old], set()
    for i, (_, t) in enumerate(new):
        s = sets(t)
        if any(sim(s, k) >= 0.7 for k in kept):
            want.add(i)
        else:
            kept.append(s)
    assert got == want


def test_tokens(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(DEFAULT_VOCABULARY)
    ref.encode_special_tokens = True
    texts = [None, "", " ", "I'll don't  stop\n\n now", "<|endoftext|> is text", "a" * 20000, "日本語 🎉 é́", "\x00\x01", "ab" * 9000 + " end", "x   y"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "n int, text string, cell string")
    got = {r.n: r.ids for r in encode(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (ref.encode(t, add_special_tokens=False).ids if t else [])
    assert all(r.decoded == (texts[r.n] or "") for r in decode(encode(df)).collect())
    assert {r.n: r.n_tokens for r in count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert encode(df.limit(0)).count() == 0


def test_long_piece_is_fast():
    import time

    c = ByteBpe(open(DEFAULT_VOCABULARY, "rb").read())
    began = time.time()
    assert c.decode(c.encode("abc" * 40000)) == "abc" * 40000
    assert time.time() - began < 20


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 7), "Big_One", 1) for i in range(300)] + [(1000 + i, "text here " * 4, " small ", 1) for i in range(20)]
    docs += [(2000, None, "small", 1), (2001, "", "small", 1), (2002, "x", None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, w int")
    t = spark.createDataFrame([("m", "big-one", 75.0, 1), ("m", "SMALL", 25.0, 3), ("m", "nowhere", 10.0, 2), ("m", None, 1.0, 1), ("n", "small", 1.0, None), ("m", "small", None, 9)],
                              "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mix(d, t)
    rows = chosen.collect()
    assert all(r.repeats <= (1 if r.source == "big-one" else 3) for r in rows if r.mix_name == "m")
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    share = {(r.mix_name, r.source): r for r in report.collect()}
    assert abs(share["m", "small"].actual_share - 0.25) < 0.02 and share["m", "nowhere"].tokens == 0
    assert share["n", "small"].actual_share == 1.0 and {r.doc_id for r in mix(d, t)[0].collect()} == {r.doc_id for r in rows}
    a, b = mix(d.limit(0), t)
    assert a.count() == 0 and b.count() == 4
    assert mix(d, t.limit(0))[1].count() == 0
    best = mix(d, t, total_tokens=300, quality=F.when(F.col("doc_id") % 3 == 0, 1000.0).otherwise(0.001))[0].filter("mix_name = 'm' and source = 'big-one'")
    assert best.count() > 5 and best.filter("doc_id % 3 = 0").count() / best.count() > 0.9
