"""Word-shingle sketches of texts, computed a batch at a time.

Words are maximal runs of letters, digits and ``_``, lower-cased; a shingle is a run of ``words``
of them; one hash function gives it 48 bits. Everything else comes from that hash:

* the set key (two sums over all shingles) is equal for texts with the same shingle set;
* the bottom-k sketch of a text is its KEEP smallest hashes. Two texts with a resemblance of the
  threshold or more share at least ``least_shared`` of them: exactly that many if the sketches are
  whole sets, else with a probability of 1 - RISK (the shared ones among the k smallest of the
  union are a hypergeometric sample);
* so under any common order each text needs only the first k - least_shared + 1 values of its
  sketch in the inverted lists, and no pair is missed. The order is rare first: by a count table
  of fixed size over all texts, so that phrases found all over the corpus make no lists, and a
  family of edited copies of any size still meets in the shingles that it shares. A value carries
  how many of its sketch follow it in that order, itself included: no more can be shared by two
  texts that meet there first, which rejects most meetings at once;
* the estimate over the union of two sketches: the hash range is cut into PLACES equal parts, and
  two bits of each part's smallest hash are kept. Where the smallest of the union is in both
  texts, the places are equal. ``may_resemble`` bounds the number of places that differ.

A batch is one array of code points: no Python runs for each word. Null texts and texts with fewer
than ``min_words`` words have no sketch. Texts are used whole, however long they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import ship

WORD = re.compile(r"\w+")
KEEP = 127
RISK = 1e-7  # chance that two texts at the threshold share fewer values than least_shared
PLACES, LO_PLACES = 52, 32
TABLE_BITS = 18
BLOCK = 1 << 20  # characters in one array
ROWS = 1 << 14  # texts at a time: their number shares a word with the hash
END = "\ud800"  # no text contains it
_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_HASH = _U((1 << 48) - 1)


@lru_cache(maxsize=1)
def _word_signs() -> np.ndarray:
    """For each code point whether it belongs to a word, as ``\\w`` has it."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _M1
    x = (x ^ (x >> _U(33))) * _M2
    return x ^ (x >> _U(33))


def _hashed(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its part) of lower-cased parts."""
    cp = np.frombuffer((END.join(parts) + END).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_signs()[cp]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, n = edge[::2], np.diff(edge)[::2]
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    at = np.flatnonzero(inside)
    place = (np.arange(len(at)) - np.repeat(first, n)).astype(_U)
    x = (cp[at].astype(_U) + (place << _U(21))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _M2
    x ^= x >> _U(32)
    return mix(np.add.reduceat(x, first) + n.astype(_U)), np.searchsorted(np.flatnonzero(cp == 0xD800), start)


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about BLOCK characters, cut between words."""
    at = 0
    while len(text) - at > BLOCK:
        cut = re.compile(r"\W").search(text, at + BLOCK)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text) of all texts."""
    hashes, owners, parts, own, size = [], [], [], [], 0
    for i, t in enumerate([*texts, None]):
        for p in _pieces(t.lower()) if t else ():
            parts.append(p)
            own.append(i)
            size += len(p)
        if parts and (size >= BLOCK or i == len(texts)):
            h, part = _hashed(parts)
            hashes.append(h)
            owners.append(np.array(own)[part])
            parts, own, size = [], [], 0
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_keys(texts: list, words: int, min_words: int) -> np.ndarray:
    """Sorted distinct text number << 48 | shingle hash of at most 2^16 texts."""
    w, doc = word_hashes(texts)
    m = len(w) - words + 1
    if m < 1:
        return np.zeros(0, _U)
    h = np.zeros(m, _U)
    for k in range(words):
        h = mix(h + w[k : k + m] * _U(2 * k + 3))
    long = np.bincount(doc, minlength=len(texts)) >= min_words
    one = (doc[:m] == doc[words - 1 :]) & long[doc[:m]]
    keys = (doc[:m][one].astype(_U) << _U(48)) | (h[one] >> _U(16))
    keys.sort()
    return keys[np.diff(keys, prepend=~keys[:1]) != 0]


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first key, number of keys) of each text that has keys."""
    doc = (keys >> _U(48)).astype(np.int64)
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[at], at, np.diff(np.append(at, len(doc)))


@lru_cache(maxsize=8)
def least_shared(threshold: float, k: int) -> np.ndarray:
    """For each number n of shingles, how many values of two bottom-k sketches are shared at least.

    Entry n holds for a text of n shingles and any partner at the threshold (threshold * n to
    n / threshold shingles), in the second row for partners of at least n; the last one for all
    larger n too.
    """
    top = 4 * k
    logf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 8 * top)))])
    choose = lambda a, b: logf[a] - logf[b] - logf[np.maximum(a - b, 0)]
    x = np.arange(k + 1)
    out = np.zeros((2, top + 1), np.int64)
    for n, lead in ((n, lead) for n in range(1, top) for lead in (0, 1)):
        m = np.arange(n if lead else int(np.ceil(n * threshold - 1e-9)), int(np.floor(n / threshold + 1e-9)) + 1)
        s = np.ceil((n + m) * threshold / (1 + threshold) - 1e-9).astype(int)
        u = n + m - s
        whole = s[u <= k]
        least = whole.min() if len(whole) else k
        s, u = s[u > k, None], u[u > k, None]
        if len(s):
            ok = (x <= s) & (k - x <= u - s)
            p = np.where(ok, np.exp(choose(s, np.minimum(x, s)) + choose(u - s, np.minimum(k - x, u - s)) - choose(u, np.full_like(u, k))), 0.0)
            least = min(least, int((np.cumsum(p, 1) > RISK).argmax(1).min()))
        out[lead, n] = least
    tail = np.cumsum([comb(k, i) * threshold**i * (1 - threshold) ** (k - i) for i in x])
    out[:, top] = np.minimum(int((tail > RISK).argmax()), out[:, top - 1])
    return out


@lru_cache(maxsize=8)
def most_different(threshold: float) -> int:
    """Places of the union estimate that differ at most, at the threshold, but for a chance of 1e-6."""
    q = (1 - threshold) * 3 / 4
    tail = np.cumsum([comb(PLACES, i) * q**i * (1 - q) ** (PLACES - i) for i in range(PLACES + 1)])
    return int((tail >= 1 - 1e-6).argmax())


def union_places(keys: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo: 32 places; hi: 20 places << 24 | number of shingles (65535 stands for more). An empty place is 0."""
    h = keys & _HASH
    place = ((h >> _U(16)) * _U(PLACES)) >> _U(32)
    row = np.repeat(np.arange(len(at)), n)
    least = np.flatnonzero(np.diff(row * PLACES + place.astype(np.int64), prepend=-1))  # keys are sorted
    bits = mix(h[least]) & _U(3)
    p, r = place[least], row[least]
    lo, hi = np.zeros(len(at), _U), np.zeros(len(at), _U)
    low = p < LO_PLACES
    np.bitwise_or.at(lo, r[low], bits[low] << (_U(2) * p[low]))
    np.bitwise_or.at(hi, r[~low], bits[~low] << (_U(2) * (p[~low] - _U(LO_PLACES)) + _U(24)))
    return lo, hi | np.minimum(n, 65535).astype(_U)


def count_cells(texts: DataFrame, text: str, words: int, min_words: int) -> bytes:
    """Texts with a shingle in each of 2^18 hash cells, over all texts; a table of fixed size (1 MiB)."""
    cells = 1 << TABLE_BITS
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                keys = shingle_keys(b.column(0).slice(s, ROWS).to_pylist(), words, min_words)
                total += np.bincount((keys & _U(cells - 1)).astype(np.int64), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    got = texts.select(text).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(cells, np.int32)
    count[got["cell"].to_numpy()] = np.minimum(got["n"].to_numpy(), (1 << 31) - 1)
    return count.tobytes()


def sketches(texts: DataFrame, idc: str, text: str, counts: bytes, threshold: float, words: int, min_words: int, k: int = KEEP) -> DataFrame:
    """(id, set_a, set_b, lo, hi, vals): one row per text that has a sketch; id: BIGINT column idc.

    vals: lead << 55 | rest << 48 | value for the values that go into inverted lists: rest is how many
    of the sketch follow, itself included, lead whether that is enough for a partner of at least the
    text's size (see ``lists``). Rows with a set that the task has seen lately have null instead:
    one of them in the lists is enough.
    """
    ship(texts.sparkSession)
    table = texts.sparkSession.sparkContext.broadcast(counts)
    least = least_shared(threshold, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = (np.log2(np.frombuffer(table.value, np.int32) + 1.0) * 8192).astype(_U), np.zeros(0, _U)  # below 2^18
        for b in (b.slice(s, ROWS) for b in batches for s in range(0, b.num_rows, ROWS)):
            keys = shingle_keys(b.column(1).to_pylist(), words, min_words)
            doc, at, n = _starts(keys)
            if not len(doc):
                continue
            h = keys & _HASH
            sa = np.add.reduceat(mix(h), at)
            sb = np.add.reduceat(mix(h ^ _U(0x5BD1E9955BD1E995)), at)
            lo, hi = union_places(keys, doc, at, n)
            new = np.zeros(len(at), bool)
            new[np.unique(sa, return_index=True)[1]] = True
            new &= ~np.isin(sa, seen)
            seen = np.concatenate([seen, sa[new]])[-(1 << 16) :]
            # The bottom-k sketch, then its first values in the order of the count table.
            row, rank = np.repeat(np.arange(len(at)), n), np.arange(len(h)) - np.repeat(at, n)
            use = (rank < k) & new[row]
            v, row = h[use], row[use]
            kept = np.minimum(n, k)
            size_at = np.minimum(n, least.shape[1] - 1)
            first = kept - least[0, size_at] + 1
            o = np.argsort((row.astype(_U) << _U(50)) | (order[(v & _U((1 << TABLE_BITS) - 1)).astype(np.int64)] << _U(32)) | (v >> _U(16)))
            size = np.where(new, kept, 0)
            place = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
            inside = place < np.repeat(first, size)
            rest = np.repeat(size, size) - place
            lead = rest >= np.repeat(least[1, size_at], size)
            v = v[o] | (rest.astype(_U) << _U(48)) | (lead.astype(_U) << _U(55))
            lists = np.append(0, np.cumsum(np.where(new, first, 0))).astype(np.int32)
            vals = pa.ListArray.from_arrays(pa.array(lists), pa.array(v[inside].view(np.int64)), mask=pa.array(~new))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *(pa.array(x.view(np.int64)) for x in (sa, sb, lo, hi)), vals],
                                             names=["id", "set_a", "set_b", "lo", "hi", "vals"])

    return texts.select(idc, text).mapInArrow(run, "id long, set_a long, set_b long, lo long, hi long, vals array<long>")


def lists(sk: DataFrame, *columns: str) -> DataFrame:
    """(value, columns, lo, hi): a row per list value of the sketches; hi has the value's rest in bits 16 to 22, its lead in bit 23."""
    v = F.col("_v")
    return sk.select(F.explode("vals").alias("_v"), *columns, "lo", "hi").select(
        v.bitwiseAND(F.lit((1 << 48) - 1)).alias("value"), *columns, "lo",
        F.col("hi").bitwiseOR(F.shiftleft(F.shiftrightunsigned(v, 48), 16)).alias("hi"))


def different_places(a: str, b: str) -> Column:
    """How many of the 52 places of two union sketches differ (both sides: lo_, hi_ columns)."""
    def differ(x: Column, y: Column, mask: int) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(mask)))

    return differ(F.col(f"lo_{a}"), F.col(f"lo_{b}"), 0x5555555555555555) + differ(F.col(f"hi_{a}"), F.col(f"hi_{b}"), 0x5555555555000000)


def can_lead(hi: str) -> Column:
    """Whether a list row can belong to the smaller text of a pair.

    A partner of at least its size shares at least 2 t / (1 + t) of the smaller text's shingles, so
    a row with less room is only good for smaller partners.
    """
    return F.shiftrightunsigned(hi, 23).bitwiseAND(F.lit(1)) == 1


def may_resemble(a: str, b: str, threshold: float, k: int = KEEP) -> Column:
    """Filter on meetings in a list: sizes, what the sketches can still share, and places that differ.

    A pair passes at the first value that it shares, if at any. A place differs only through a
    shingle that one text alone has, and at the threshold there are at most
    (n_a + n_b) (1 - t) / (1 + t) of them.
    """
    na, nb = (F.col(f"hi_{x}").bitwiseAND(F.lit(65535)) for x in (a, b))
    ra, rb = (F.shiftrightunsigned(f"hi_{x}", 16).bitwiseAND(F.lit(127)) for x in (a, b))
    many = F.greatest(na, nb) == 65535
    sizes = ((na >= nb * threshold - 1e-6) & (nb >= na * threshold - 1e-6)) | many
    need = F.when(F.greatest(na, nb) > k, F.lit(float(least_shared(threshold, k)[0, int(k * threshold) :].min()))).otherwise((na + nb) * (threshold / (1 + threshold)) - 1e-6)
    d, own = different_places(a, b), (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return sizes & (F.least(ra, rb) >= need) & (d <= most_different(threshold)) & ((d <= own) | many)


def _tuples(text: str, words: int) -> frozenset:
    w = WORD.findall(text.lower())
    return frozenset(zip(*(w[i:] for i in range(words))))


def resemblances(left: list, right: list, threshold: float, words: int, min_words: int) -> np.ndarray:
    """Resemblance of each pair of texts, on whole texts; those near the threshold word by word."""
    texts = list(dict.fromkeys(x for x in (*left, *right) if x))
    number = {t: i for i, t in enumerate(texts)}
    keys = shingle_keys(texts, words, min_words)
    doc, at, n = _starts(keys)
    start, size = np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts) + 1, np.int64)
    start[doc], size[doc] = at, n
    i, j = (np.array([number.get(x, len(texts)) for x in side]) for side in (left, right))
    h = keys & _HASH

    def rows(x: np.ndarray) -> np.ndarray:
        pair = np.repeat(np.arange(len(x)), size[x])
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(size[x]) - size[x], size[x])
        return (pair.astype(_U) << _U(48)) | h[start[x][pair] + inside]

    both = np.concatenate([rows(i), rows(j)])
    both.sort(kind="stable")
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> _U(48)).astype(np.int64), minlength=len(left))
    union = size[i] + size[j] - common
    r = common / np.maximum(union, 1)
    near = (common > 0) & (r >= threshold) & ((common - 1) < threshold * (union + 1))
    for x in np.flatnonzero(near):  # a collision of hashes could decide these
        p, q = _tuples(left[x], words), _tuples(right[x], words)
        r[x] = len(p & q) / len(p | q)
    return r


def exact_pairs(pairs: DataFrame, text_a: str, text_b: str, threshold: float, words: int, min_words: int) -> DataFrame:
    """The pairs whose texts have a resemblance of at least the threshold, with it."""
    ship(pairs.sparkSession)
    ia, ib = pairs.columns.index(text_a), pairs.columns.index(text_b)
    keep = [f for f in pairs.schema.fields if f.name not in (text_a, text_b)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", resemblance double"
    at = [pairs.columns.index(f.name) for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(s, 2048) for b in batches for s in range(0, b.num_rows, 2048)):
            r = resemblances(b.column(ia).to_pylist(), b.column(ib).to_pylist(), threshold, words, min_words)
            ok = pa.array(r >= threshold)
            cols = [b.column(i).filter(ok) for i in at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r).filter(ok)], names=[*(f.name for f in keep), "resemblance"])

    return pairs.mapInArrow(run, schema)
