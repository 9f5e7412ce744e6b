import numpy as np

from corpuslens.llm.abuse import fit, passages, plain, rows, score_documents, scores, source_rates

BAD = ["you are a worthless idiot", "shut up you stupid moron", "go away you filthy pig", "nobody likes you dumb loser"]
GOOD = ["the meter counts the open invoice", "please restart the standard console first", "a signed report keeps the older value", "the stupid default is fine for a smart idiot proof setup"]


def corpus(n, seed):
    rng = np.random.RandomState(seed)
    texts, y = [], []
    for i in range(n):
        s = [f"{GOOD[rng.randint(4)]} number {rng.randint(99)}." for _ in range(4)]
        bad = i % 6 == 0
        if bad:
            s.insert(rng.randint(4), BAD[rng.randint(4)].replace("i", rng.choice(["i", "1"])) + "!")
        texts.append(" ".join(s))
        y.append(int(bad != (rng.rand() < 0.03)))
    return texts, np.array(y), np.array([i % 6 == 0 for i in range(n)])


def test_plain():
    assert plain("Y0u 1d1ot, t3$t 72,264") == "you idiot test #"
    assert plain("s.t.u.p.i.d") == "stupid"
    assert passages(None) == [] and passages(" \n ") == []


def test_rows_and_scores_agree():
    p = ["hello world", "you are here", "abc"]
    m = rows(p)
    w = np.random.RandomState(0).randn(m.shape[1]).astype(np.float32)
    assert np.allclose(scores(p, w), m @ w, atol=1e-3)


def test_held_out_accuracy():
    t, y, _ = corpus(400, 1)
    w, th = fit(t, y)
    t2, _, truth = corpus(300, 2)
    found = np.array([(scores(passages(x), w) > th).any() for x in t2])
    assert (found == truth).mean() > 0.95


def test_documents(spark):
    t, y, truth = corpus(240, 3)
    d = [(i, x, "A_b" if i % 2 else " a-b ", 1.0) for i, x in enumerate(t)] + [(900, None, None, 1.0), (901, "", "s", 1.0), (902, " ", "s", 1.0), (903, "x" * 50000, "s", 1.0)]
    docs = spark.createDataFrame(d, "doc_id long, text string, source string, score double")
    lab = [(i, int(v), 1) for i, v in enumerate(y)] + [(0, int(y[0]), 2), (None, 1, 1), (5, None, 3), (77777, 1, 1)]
    labels = spark.createDataFrame(lab, "doc_id long, toxic int, rater int")
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert np.mean([got[i].abusive == bool(v) for i, v in enumerate(truth)]) > 0.95
    assert got[900].score is None and got[901].score is None and got[902].score is None and not got[903].abusive
    rates = {r.source: r.n_documents for r in source_rates(score_documents(docs, labels)).collect()}
    assert rates["a-b"] == 240 and rates[None] == 1
    none = score_documents(docs, labels.limit(0)).collect()
    assert len(none) == 244 and not any(r.abusive for r in none)
