"""Byte-level BPE of a public vocabulary, written as a merge queue.

A text is cut by the vocabulary's public pattern; each piece is a doubly linked list of byte
symbols and a heap of (merge rank, position). The smallest rank is merged first; entries whose
symbols have changed since are stale and skipped. A piece of n bytes costs O(n log n), also when
it is very long. Pieces recur, so each worker keeps a cache of bounded size.

Defined results: null and empty texts have an empty list of ids; marks of special tokens inside a
text are ordinary text; decoding concatenates the vocabulary's byte strings and is the exact
inverse. Rows and extra columns stay as they are; an empty table stays empty.

The vocabulary file is read once by the driver and broadcast: its size is that of one published
file (1.6 MB) and does not grow with the data.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpuslens.session import ship

DEFAULT_VOCABULARY = os.environ.get("CORPUSLENS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES, CACHE_BYTES = 1 << 17, 64


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr({**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}[b]) for b in range(256)]


class ByteBpe:
    def __init__(self, raw: bytes):
        import regex

        model = json.loads(raw)["model"]
        vocab: dict[str, int] = model["vocab"]
        signs = byte_signs()
        self.first = [vocab[s] for s in signs]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        back = {s: b for b, s in enumerate(signs)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        sym = [self.first[b] for b in data]
        n, merge = len(sym), self.merge
        if n < 2:
            return sym
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := merge.get((sym[i], sym[i + 1])):
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:  # stale
                continue
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := merge.get((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = prv[i]
            if h >= 0 and (m := merge.get((sym[h], new))):
                heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for w in self.split(text or ""):
            ids = cache.get(w)
            if ids is None:
                ids = self.piece(w.encode())
                if len(w) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode()


_LOADED: dict[int, ByteBpe] = {}


def _codec(raw) -> ByteBpe:  # noqa: ANN001
    key = raw.id if hasattr(raw, "id") else 0
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(raw.value)
    return _LOADED[key]


def _with(df: DataFrame, vocabulary: str, text: str, name: str, kind: T.DataType, build) -> DataFrame:  # noqa: ANN001
    ship(df.sparkSession)
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw)
        for b in batches:
            col = build(codec, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def _lists(codec: ByteBpe, texts: list) -> pa.Array:
    ids = [codec.encode(t) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, text: str = "text", name: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df with a column of token ids."""
    return _with(df, vocabulary, text, name, T.ArrayType(T.IntegerType(), True), _lists)


def count_tokens(df: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df with the number of tokens."""
    return _with(df, vocabulary, text, name, T.LongType(), lambda c, ts: pa.array([len(c.encode(t)) for t in ts], pa.int64()))


def decode(df: DataFrame, ids: str = "ids", name: str = "decoded", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df with the text of a column of token ids."""
    return _with(df, vocabulary, ids, name, T.StringType(), lambda c, xs: pa.array([c.decode(x or []) for x in xs], pa.string()))
