"""Text dedup on exact shingle sets: inverted index with a rare-first prefix, exact verification.

Two sets with a Jaccard similarity of at least t share an element among the first
n - ceil(t n) + 1 of each set under any common order; with the rarest first, the joined lists are
short and no pair is missed. The order comes from a count table of fixed size over all texts, so
that it is known inside a row and no set is taken apart and put together again. Texts that are
equal word for word are one vertex from the start, so copies never meet in the join; a text
without words has one empty shingle, like its copies.

Whole shingle sets are larger than the texts, so no table holds them: they are computed from the
words, a batch at a time, for the counts, for the prefixes and for the texts of the candidates.
Inside the join two exact bounds reject nearly all meetings: what is left of both sets from their
first common shingle on, and the bits in which their parity maps differ (a bit differs only
through a shingle that one text alone has).

Shingles are 64-bit hashes from the start: two different ones collide in a pair of texts of a
thousand words with a probability of 1e-13.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import word_line
from corpuslens.session import Stage, ship

CELLS = 1 << 18
PARTS = 2  # the lists are joined in so many parts, so that only one of them lies in shuffle files
BLOCK = 1 << 20  # bytes of text in one array
ROWS, BYTES = 1 << 13, 1 << 22  # texts at a time, as many as are no longer than that together, but one at least
PAIRS = 1 << 10  # pairs at a time
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _ends(line: pa.Array) -> np.ndarray:
    """Where the bytes of each text begin and end, in the buffer of a large_string array."""
    return np.frombuffer(line.buffers()[1], np.int64)[line.offset : line.offset + len(line) + 1]


def _slices(b: pa.RecordBatch, *columns: int, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and about BYTES bytes in its text columns."""
    if not b.num_rows:
        return
    size = sum(_ends(b.column(c).cast(pa.large_string())) for c in columns)
    at = 0
    while at < b.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(size, size[at] + BYTES, "right")) - 1))
        yield b.slice(at, to - at)
        at = to


def _word_hashes(line: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of lines of words with one space between."""
    line = line.cast(pa.large_string())
    size, raw = _ends(line), line.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[size[0] : size[-1]] if raw is not None else np.zeros(0, np.uint8)
    size = size - size[0]
    space, full = np.flatnonzero(data == 32), np.diff(size) > 0
    count = np.where(full, np.diff(np.searchsorted(space, size)) + 1, 0)
    begin = np.concatenate([size[:-1][full], space + 1])
    end = np.concatenate([size[1:][full], space])
    begin.sort()
    end.sort()
    out, at = np.zeros(len(begin), _U), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK, "right")))
        n = end[at:to] - begin[at:to]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        x = (data[place + np.repeat(begin[at:to], n)].astype(_U) + (place.astype(_U) << _U(8)) + _U(1)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
        out[at:to] = _mix(np.add.reduceat(x ^ (x >> _U(32)), first) + n.astype(_U))
        at = to
    return out, count


def _shingles(line: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, repeated ones too, number of its text); a short text has one of all its words."""
    w, n = _word_hashes(line)
    slots = np.maximum(n, k)
    start = np.cumsum(slots) - slots
    x = np.zeros(slots.sum(), _U)  # a word that is missing is 0
    x[np.arange(len(w)) + np.repeat(start - (np.cumsum(n) - n), n)] = w
    row = np.repeat(np.arange(len(n)), slots)
    m = len(x) - k + 1
    if m < 1:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.zeros(m, _U)
    for i in range(k):
        h = _mix(h + x[i : i + m] * _U(2 * i + 3))
    one = row[:m] == row[k - 1 :]
    return h[one], row[:m][one]


def _by_row(h: np.ndarray, row: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Sorting by row, order and hash; row and order are below 2^16."""
    o = np.argsort(h)
    for key in (*order, row):
        o = o[np.argsort(key[o].astype(np.uint16), kind="stable")]
    return o


def _sets(line: pa.Array, k: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles text after text, how many each text has), in the order of their ranks, then hashes."""
    h, row = _shingles(line, k)
    o = _by_row(h, row, *([] if ranks is None else [ranks[(h & _U(CELLS - 1)).astype(np.int64)]]))
    h, row = h[o], row[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(line))


def _counts(texts: DataFrame, k: int, stage: Stage) -> np.ndarray:
    """Rank of each of the cells of the shingles, rare ones first: 16 bits from their numbers in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for part in _slices(b, 0):
                total += np.bincount((_shingles(part.column(0), k)[0] & _U(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    got = stage.put(texts.select("line").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")), "counts").toArrow()  # CELLS rows at most
    stage.done("counts")
    count = np.zeros(CELLS, np.int64)
    count[got["c"].to_numpy()] = got["n"].to_numpy()
    return np.minimum(np.log2(count + 1.0) * 1024, 65535).astype(np.uint16)


def _sketches(texts: DataFrame, threshold: float, k: int, stage: Stage) -> DataFrame:
    """(chunk_id, h, n, bits, pre): number of shingles, parity map and prefix of each text; h: its words."""
    ship(texts.sparkSession)
    table = texts.sparkSession.sparkContext.broadcast(_counts(texts, k, stage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in _slices(b, 2)):
            h, n = _sets(b.column(2), k, table.value)
            start = np.cumsum(n) - n
            bits = np.bitwise_xor.reduceat(_U(1) << (h >> _U(58)), start)
            keep = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            inside = np.arange(len(h)) - np.repeat(start, n) < np.repeat(keep, n)
            ends = np.append(0, np.cumsum(keep)).astype(np.int32)
            pre = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[inside].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int32)), pa.array(bits.view(np.int64)), pre],
                                             names=["chunk_id", "h", "n", "bits", "pre"])

    keyed = texts.select("chunk_id", F.unhex(F.md5("line")).alias("h"), "line")
    return keyed.mapInArrow(run, "chunk_id string, h binary, n int, bits long, pre array<long>")


def _may_reach(threshold: float) -> Column:
    """Whether two list rows can be of similar texts: sizes, what both still have from here on, parity maps.

    A pair passes at its first common shingle. All of it names both sides, so it stays in the join
    and the two sides are one exchange.
    """
    na, nb = (F.shiftright(f"m_{x}", 32) for x in "ab")
    ra, rb = (F.col(f"m_{x}").bitwiseAND(F.lit((1 << 32) - 1)) for x in "ab")
    sizes = (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9)
    left = F.least(ra, rb) >= (na + nb) * (threshold / (1 + threshold)) - 1e-6
    own = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return sizes & left & own


def _candidates(v: DataFrame, threshold: float, part: int) -> DataFrame:
    """Distinct (id_a, id_b) that meet in a prefix of one part of the shingles and pass the bounds."""
    p = v.select("id", "n", "bits", F.posexplode("pre").alias("at", "s")).filter(F.pmod(F.shiftright("s", 20), F.lit(PARTS)) == part)
    p = p.select("s", "id", "bits", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("n") - F.col("at")).cast("long")).alias("m"))
    side = lambda c: p.select("s", *[F.col(x).alias(f"{x}_{c}") for x in ("id", "bits", "m")])
    return side("a").join(side("b"), "s").filter((F.col("id_a") < F.col("id_b")) & _may_reach(threshold)).select("id_a", "id_b").distinct()


def _verified(pairs: DataFrame, threshold: float, k: int) -> DataFrame:
    """(vid_a, vid_b, jaccard) of the pairs (vid_a, vid_b, line_a, line_b) with at least the threshold."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in _slices(b, 2, 3, rows=PAIRS)):
            m = b.num_rows
            lines = pa.chunked_array([b.column(2), b.column(3)]).combine_chunks().dictionary_encode()
            h, n = _sets(lines.dictionary, k)
            which = lines.indices.to_numpy()
            size = n[which]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x, pair = h[np.repeat((np.cumsum(n) - n)[which], size) + inside], np.repeat(np.arange(2 * m) % m, size)
            o = _by_row(x, pair)
            x, pair = x[o], pair[o]
            both = np.bincount(pair[1:][(x[1:] == x[:-1]) & (pair[1:] == pair[:-1])], minlength=m)
            j = both / (size[:m] + size[m:] - both)
            ok = pa.array(j >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(j).filter(ok)], names=["vid_a", "vid_b", "jaccard"])

    return pairs.select("vid_a", "vid_b", "line_a", "line_b").mapInArrow(run, "vid_a string, vid_b string, jaccard double")


def copies(chunks: DataFrame) -> DataFrame:
    """(chunk_id, vid) for every chunk."""
    w = chunks.select("chunk_id", F.md5(word_line("text")).alias("h"))
    lead = w.groupBy("h").agg(F.min("chunk_id").alias("vid"))
    return w.join(lead, "h").select("chunk_id", "vid")


def prefixes(vertices: DataFrame, threshold: float) -> DataFrame:
    """(vid, n, s): the rarest shingles of each vertex, as many as a pair at the threshold needs."""
    ship(vertices.sparkSession)
    cell = F.pmod("s", F.lit(CELLS)).cast("int")
    got = vertices.select(F.explode("sh").alias("s")).groupBy(cell.alias("c")).agg(F.count("*").alias("n")).toArrow()  # CELLS rows at most
    count = np.zeros(CELLS, np.int64)
    count[got["c"].to_numpy()] = got["n"].to_numpy()
    table = vertices.sparkSession.sparkContext.broadcast(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, s = b.column(1).to_numpy(), b.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            o = np.lexsort((s, table.value[s & (CELLS - 1)], row))
            keep = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            first = o[np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) < keep[row]]
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s[first])], names=["vid", "n", "s"])

    return vertices.select("vid", "n", "sh").mapInArrow(run, "vid string, n int, s long")


def _pairs_and_copies(chunks: DataFrame, threshold: float, k: int, with_copies: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(vid_a, vid_b, jaccard) of similar texts; if asked, (vid, chunk_id) of the copies of each word sequence but its smallest id."""
    stage = Stage(chunks.sparkSession, "text-dedup")
    texts = chunks.filter("chunk_id is not null").select("chunk_id", word_line("text").alias("line"))
    sk = stage.put(_sketches(texts, threshold, k, stage), "sketches")
    v = sk.groupBy("h").agg(F.min(F.struct("chunk_id", "n", "bits", "pre")).alias("m")).select("h", F.col("m.chunk_id").alias("vid"), "m.n", "m.bits", "m.pre")
    v = stage.put(v.withColumn("id", F.monotonically_increasing_id()), "vertices")
    same = None
    if with_copies:
        same = stage.put(sk.select("h", "chunk_id").join(v.select("h", "vid"), "h").filter("chunk_id != vid").select("vid", "chunk_id"), "copies")
    stage.done("sketches")
    found = [stage.put(_candidates(v, threshold, p), f"candidates{p}") for p in range(PARTS)]
    cand = stage.put(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    need = cand.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().join(v.select("id", "vid", "h"), "id")
    full = need.join(chunks.select(F.col("chunk_id").alias("vid"), "text"), "vid").select("id", "vid", "h", word_line("text").alias("line"))
    full = stage.put(full.filter(F.unhex(F.md5("line")) == F.col("h")).select("id", "vid", "line"), "texts")
    stage.done("vertices", *[f"candidates{p}" for p in range(PARTS)])
    side = lambda c: full.select(*[F.col(x).alias(f"{x}_{c}") for x in ("id", "vid", "line")])
    pairs = stage.put(_verified(cand.join(side("a"), "id_a").join(side("b"), "id_b"), threshold, k).distinct(), "pairs")
    stage.done("texts", "candidates")
    return pairs.select(F.least("vid_a", "vid_b").alias("vid_a"), F.greatest("vid_a", "vid_b").alias("vid_b"), "jaccard"), same


def similar_texts(chunks: DataFrame, threshold: float = 0.8, k: int = 3) -> DataFrame:
    """(vid_a, vid_b, jaccard) of different word sequences with at least the threshold."""
    return _pairs_and_copies(chunks, threshold, k, with_copies=False)[0]


def text_edges(chunks: DataFrame, threshold: float = 0.8, k: int = 3) -> DataFrame:
    """(a, b): similar texts, and a star for each set of copies."""
    pairs, same = _pairs_and_copies(chunks, threshold, k)
    return pairs.select(F.col("vid_a").alias("a"), F.col("vid_b").alias("b")).unionByName(same.select(F.col("vid").alias("a"), F.col("chunk_id").alias("b")))
