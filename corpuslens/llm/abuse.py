"""Scoring texts for abusive, hateful or sexual passages.

Kernel: gap-weighted subsequences of four characters (span up to six, decay 0.6 a gap), which
tolerates inserted, dropped and swapped characters; spelled-out and look-alike letters are mapped
before. The map into subsequence space is explicit and signed-hashed to 2^14 places, which keeps
inner products to about 0.008, so a kernel value is a product of two rows.

Model: a support vector machine (squared hinge) on Nyström features of landmark sentences. The
trained function is linear in subsequence space, so it is folded into one weight per place and
scoring a sentence costs no kernel evaluation: one pass over its characters.

Labels are verdicts on whole documents, with errors, so sentences are learnt as bags: sentences of
documents judged clean are negative; of each document judged abusive the sentence with the highest
score is positive in the next round; a positive that the model puts with the negatives, and a
negative that it puts far with the positives, is taken for a wrong verdict and left out.

The fit takes at most ``max_documents`` labelled documents (documented bound, chosen by hash), and of
their clean passages BASE at random and the HARD ones with the highest scores. Scores and rates
cover all documents and whole texts. A document's score is the highest of its passages.

Defined results: null, empty and blank texts have no passage and score null; labels that are null
or tied are ignored; repeated labels count as votes; without labels of both kinds no document is
found and all scores are null; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import ship

PLACES, SPAN, DECAY = 1 << 14, 6, 0.6
OFFSETS = [(i, j, k) for i in range(1, SPAN - 2) for j in range(i + 1, SPAN - 1) for k in range(j + 1, SPAN)]
# Signs commonly written for letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "ß": "s"})
SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\r\n]+|\s\|\s")
SPELLED = re.compile(r"(?<!\w)(?:\w[\s.\-_*·]{1,2}){3,}\w(?!\w)")
NUMBER = re.compile(r"(?<![^\W_])\d[\d.,:]*(?![^\W_])")
INNER = re.compile(r"(?<=\w)[@$!](?=\w)|(?<!\w)[@$](?=\w)|(?<=\w)[$](?!\w)")
OTHER = re.compile(r"[^\w#]+|_+")
WORDS, STEP = 20, 8
COARSE, ALIKE, MARGIN = 512, 0.5, 0.15
BASE, HARD = 5000, 3000


def plain(sentence: str) -> str:
    s = sentence.lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        s = "".join(c for c in s if not unicodedata.combining(c) and c not in "\u200b\u200c\u200d\u00ad")
    s = SPELLED.sub(lambda m: re.sub(r"[\W_]", "", m.group()), s)
    s = NUMBER.sub("#", s)
    if "@" in s or "$" in s or "!" in s:
        s = INNER.sub(lambda m: m.group().translate(LOOKALIKE), s)
    words = OTHER.sub(" ", s.replace("*", "")).split()
    if "".join(words).replace("#", "").isalpha():
        return " ".join(words)
    return " ".join(w if w.isalpha() or w == "#" else w.translate(LOOKALIKE) for w in words)


def passages(text: str | None) -> list[str]:
    """Normalised sentences of at least two letters, long ones also in overlapping windows."""
    out = []
    for s in SENTENCE.split(text or ""):
        p = plain(s) if s else ""
        if len(p) < 2:
            continue
        w = p.split()
        if len(w) <= WORDS:
            out.append(p)
        else:
            out += [" ".join(w[i : i + WORDS]) for i in range(0, max(1, len(w) - STEP), STEP)]
    return out


def _codes(passage_list: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Six-bit character codes of all passages, each with a space before and after; and their ends."""
    raw = (" " + "\n ".join(passage_list) + "\n").encode("utf-32-le") if passage_list else b""
    c = np.frombuffer(raw, np.uint32)
    brk = c == 10
    code = np.where((c >= 97) & (c <= 122), c - 96, np.where((c == 32) | brk, 27, np.where(c == 35, 28, 29 + c % 35)))
    return code.astype(np.uint32), np.flatnonzero(brk) + 1


def features(c: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: places (signed by their top bit), whether they lie in one passage, weight."""
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(c))
    for i, j, k in OFFSETS:
        n = len(c) - k
        if n <= 0:
            continue
        h = (c[:n] << np.uint32(18)) | (c[i : i + n] << np.uint32(12)) | (c[j : j + n] << np.uint32(6)) | c[k:]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        yield h >> np.uint32(17), left[:n] > k, DECAY ** (k - 3)


def _norms(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each passage, norm of its occurrences)."""
    n = np.diff(ends, prepend=0)
    sq = sum(DECAY ** (2 * (k - 3)) * np.maximum(n - k, 0) for _, _, k in OFFSETS)
    return ends - n, np.sqrt(np.maximum(sq, 1e-9))


def scores(passage_list: list[str], weight: np.ndarray) -> np.ndarray:
    """weight: PLACES values; the product of each passage's normalised row with it."""
    if not passage_list:
        return np.zeros(0)
    c, ends = _codes(passage_list)
    start, norm = _norms(ends)
    both = np.concatenate([weight, -weight]).astype(np.float32)
    total = np.zeros(len(c), np.float32)
    for h, ok, w in features(c, ends):
        total[: len(h)] += both[h] * (ok * np.float32(w))
    return np.add.reduceat(total, start) / norm


def rows(passage_list: list[str], places: int = PLACES) -> np.ndarray:
    """Dense normalised rows in subsequence space."""
    c, ends = _codes(passage_list)
    start, norm = _norms(ends)
    n = np.diff(np.append(start, len(c)))
    owner = np.repeat(np.arange(len(passage_list)), n) * places
    at, val = [], []
    for h, ok, w in features(c, ends):
        h = h[ok]
        at.append(owner[: len(ok)][ok] + (h & np.uint32(places - 1)))
        val.append(np.where(h >= PLACES, -w, w))
    out = np.bincount(np.concatenate(at), np.concatenate(val), minlength=len(passage_list) * places) if at else np.zeros(len(passage_list) * places)
    return (out.reshape(-1, places) / norm[:, None]).astype(np.float32)


def evidence(flat: list[str], owner: np.ndarray, other: list[str], other_doc: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of flat: documents among owner's, and among other_doc's, with an alike passage."""
    def unit(x: list[str]) -> np.ndarray:
        m = np.concatenate([rows(x[i : i + 512], COARSE) for i in range(0, len(x), 512)])
        return m / np.maximum(np.sqrt((m * m).sum(1)), 1e-9)[:, None]

    mine, theirs = unit(flat), unit(other)
    count = []
    for m, d in ((mine, owner), (theirs, other_doc)):
        at = np.flatnonzero(np.diff(d, prepend=-1))
        count.append(np.concatenate([(np.maximum.reduceat(mine[i : i + block] @ m.T, at, axis=1) >= ALIKE).sum(1) for i in range(0, len(flat), block)]))
    return count[0], count[1]


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, lam: float) -> np.ndarray:
    """Squared hinge by Newton steps; the last column of z is the bias."""
    w = np.zeros(z.shape[1])
    ridge = lam * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        act = y * (z @ w) < 1
        za, ca = z[act], cost[act, None]
        new = np.linalg.solve(ridge + za.T @ (za * ca), za.T @ (ca[:, 0] * y[act]))
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def fit(texts: list[str], labels: np.ndarray, landmarks: int = 384, rounds: int = 4, lam: float = 0.1, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weight per place, threshold) from documents and their verdicts (1 or 0)."""
    bags = [list(dict.fromkeys(passages(t))) for t in texts]
    pos = [b for b, l in zip(bags, labels) if l == 1 and b]
    neg = [b for b, l in zip(bags, labels) if l == 0 and b]
    if not pos or not neg:
        return np.zeros(PLACES, np.float32), np.inf
    flat, clean = [p for b in pos for p in b], [p for b in neg for p in b]
    owner, clean_doc = (np.repeat(np.arange(len(x)), [len(b) for b in x]) for x in (pos, neg))
    # Passages whose like is found mostly in documents judged abusive.
    a, b = evidence(flat, owner, clean, clean_doc)
    share = (a - 0.5) / (a + b * len(pos) / max(len(pos), len(neg)) + 0.5)
    good_seed = (a >= 2) & (a > 0.5 * (a + b))
    if not good_seed.any():
        good_seed = b == 0
    if not good_seed.any():
        good_seed = share >= share.max()
    rng = np.random.RandomState(seed)
    pick = lambda n, k: rng.choice(n, min(n, max(0, k)), replace=False)
    # Passages that recur in clean documents, and there more than in the others, are clean for sure.
    often, rare = Counter(clean), Counter(flat)
    sure = [p for p, n in often.most_common(landmarks) if n >= 3 and n > 2 * rare[p]]
    clean = list(dict.fromkeys(clean))
    base = [clean[i] for i in np.sort(pick(len(clean), BASE))]
    use, negs = np.flatnonzero(good_seed), list(dict.fromkeys(sure + base))
    weight, bias = None, 0.0
    for r in range(rounds):
        marks = [flat[i] for i in use[pick(len(use), landmarks // 2)]]
        if weight is not None:  # the hardest clean passages, but for those of wrong verdicts
            s = scores(clean, weight) + bias
            order = np.argsort(-s)
            hard = [clean[i] for i in order[s[order] < (0.9 if r == 1 else 0.6)][:HARD]]
            negs = list(dict.fromkeys(sure + hard + base))
            marks += hard[: landmarks // 6]
        marks += sure[: landmarks // 4]
        marks += [negs[i] for i in pick(len(negs), landmarks - len(marks))]
        m = rows(list(dict.fromkeys(marks)))
        val, vec = np.linalg.eigh((m @ m.T).astype(np.float64))
        ok = val > 1e-3
        half = vec[:, ok] / np.sqrt(val[ok])
        x = list(dict.fromkeys(flat[i] for i in use))
        z = np.concatenate([rows(s[i : i + 256]) @ m.T for s in (x, negs) for i in range(0, len(s), 256)]) @ half
        y = np.append(np.ones(len(x)), -np.ones(len(negs)))
        seen = np.array([1 + np.log(often[p]) if p in often else 1.0 for p in negs])
        cost = np.append(np.full(len(x), min(6.0, len(negs) / max(1, len(x)) / 2)), seen)
        w = _svm(np.column_stack([z, np.ones(len(z))]), y, cost, lam)
        weight, bias = (m.T @ (half @ w[:-1])).astype(np.float32), float(w[-1])
        s = scores(flat, weight) + bias
        best = np.lexsort((-s, owner))[np.flatnonzero(np.diff(owner, prepend=-1))]
        best = best[(s[best] > 0) & (a[best] >= b[best])]
        use = np.union1d(np.flatnonzero(good_seed & (s > -0.5)), best)
    return weight, -bias - MARGIN


def train(documents: DataFrame, labels: DataFrame, max_documents: int = 6000) -> tuple[np.ndarray, float]:
    """Fits on a bounded sample of the labelled documents, in one task."""
    ship(documents.sparkSession)
    votes = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("m"))
    votes = votes.filter("m != 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    picked = votes.orderBy("h").limit(max_documents)  # in their natural proportion, which the evidence relies on
    bag = documents.select("doc_id", "text").join(picked, "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [(h, x or "", y) for b in batches for h, x, y in zip(b["h"].to_pylist(), b["text"].to_pylist(), b["y"].to_pylist())]
        t.sort()
        w, th = fit([x for _, x, _ in t], np.array([y for _, _, y in t]))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([float(th)])], names=["w", "th"])

    got = bag.select("h", "text", "y").repartition(1).mapInArrow(run, "w binary, th double").first()
    if got is None:
        return np.zeros(PLACES, np.float32), np.inf
    return np.frombuffer(got["w"], np.float32), got["th"]


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, abusive): score over 0 is abusive."""
    weight, th = train(documents, labels)
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast((weight, th))  # 64 KiB, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = model.value
        for b in batches:
            best = np.full(b.num_rows, np.nan)
            at, flat, own = b.schema.get_field_index("text"), {}, []  # passages that recur are scored once
            for i, x in enumerate([*b.column(at).to_pylist(), None]):
                own += [(i, flat.setdefault(p, len(flat))) for p in passages(x)] if x else []
                if own and (len(flat) > 4000 or i == b.num_rows):
                    who, what = np.array(own).T
                    np.fmax.at(best, who, (scores(list(flat), w) - t)[what])
                    flat, own = {}, []
            s = pa.array(np.where(np.isfinite(best), best, 0.0), mask=~np.isfinite(best))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), s], names=["doc_id", "source", "score"])

    out = documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double")
    return out.withColumn("abusive", F.coalesce(F.col("score") > 0, F.lit(False)))


def source_rates(scored: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.lower(F.trim("source")), "_", "-")
    return scored.groupBy(name.alias("source")).agg(
        F.count("*").alias("n_documents"), F.sum(F.col("abusive").cast("int")).alias("n_abusive"),
        F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"))
