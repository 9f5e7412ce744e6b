"""Overlapping chunker and Unicode normalisation: stateful text routines in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpuslens.session import ship

SIZE, OVERLAP, SENTENCE_ZONE, WORD_ZONE = 800, 100, 120, 60


def nfkc(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the column in NFKC form; null stays null."""
    at = df.columns.index(column)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [x if x is None else unicodedata.normalize("NFKC", x) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(t, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def pieces(text: str | None) -> list[str]:
    """Chunks of at most SIZE characters that overlap by about OVERLAP.

    A cut falls after the last full stop (or else the last space) of its final zone. The next
    chunk begins OVERLAP before the cut, or at the cut if that is no step forward. Blank chunks
    are dropped; a text of at most SIZE is one chunk as it is. Null and empty texts give none.
    """
    if not text:
        return []
    if len(text) <= SIZE:
        return [text]
    out, at = [], 0
    while True:
        end = min(at + SIZE, len(text))
        if end < len(text):
            zones = ((mark, max(at, end - zone)) for mark, zone in ((". ", SENTENCE_ZONE), (" ", WORD_ZONE)))
            cut = next((c for c in (text.rfind(mark, low, end) for mark, low in zones) if c >= 0), -1)
            end = cut + 1 if cut > at else end
        if piece := text[at:end].strip():
            out.append(piece)
        if end == len(text):
            return out
        at = end - OVERLAP if end - OVERLAP > at else end


def chunk_documents(df: DataFrame, idc: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, chunk_no, text): the chunks of each document."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[idc], T.StructField("chunk_no", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, txt = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, p in enumerate(pieces(t)):
                    at.append(i)
                    no.append(k)
                    txt.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(no, pa.int32()), pa.array(txt, pa.string())],
                                             names=[idc, "chunk_no", "text"])

    return df.select(idc, column).mapInArrow(run, schema)
