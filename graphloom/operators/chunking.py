"""Chunkers: sentence packing for extraction, overlapping passages for retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_EXTRACT = re.compile(r"(?<=[。！？；!?;])\s*|\n+")
_RETRIEVE = re.compile(r"(?<=[。！？；!?;])|(?<=\n)")


def _sentences(text: str, boundary: re.Pattern) -> list[str]:
    return [s for part in boundary.split(text) if part and (s := part.strip())]


def _fill(units: list[str], room: int, gap: int) -> Iterator[list[str]]:
    """Runs of units, each as long as its lengths plus *gap* per unit stay within *room*."""
    run, used = [], 0
    for u in units:
        need = len(u) + gap
        if run and used + need > room:
            yield run
            run, used = [], 0
        run.append(u)
        used += need
    if run:
        yield run


def _slices(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(0, len(text), n)]


def split_long(sentence: str, size: int) -> list[str]:
    """Pieces of at most *size* characters: whole words where there are blanks, else plain slices."""
    if len(sentence) <= size:
        return [sentence] if sentence else []
    if " " not in sentence:
        return _slices(sentence, size)
    out, words = [], []

    def flush():
        # joined by one blank, the last word has none after it
        out.extend(" ".join(run) for run in _fill(words, size + 1, 1))
        words.clear()

    for w in sentence.split():
        if len(w) > size:
            flush()
            out.extend(_slices(w, size))
        else:
            words.append(w)
    flush()
    return out


def pack_sentences(text: str | None, size: int = 500) -> list[str]:
    """Chunks of whole sentences, at most *size* characters; no overlap."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    out, waiting = [], []
    for s in [*_sentences(text, _EXTRACT), None]:
        if s is not None and len(s) <= size:
            waiting.append(s)
            continue
        # a sentence of exactly *size* has no room for its blank, yet is a chunk of its own
        out.extend(" ".join(run) for run in _fill(waiting, size, 1))
        waiting = []
        out.extend(split_long(s, size) if s else [])
    return out


def overlap_passages(text: str | None, size: int = 800, overlap: int = 120) -> list[str]:
    """Chunks of whole sentences, each led by the last sentences (up to *overlap* characters) of the one before."""
    out: list[str] = []
    held: list[str] = []

    def length(parts: list[str]) -> int:
        return sum(map(len, parts)) + len(parts)

    for s in _sentences((text or "").strip(), _RETRIEVE):
        if length(held) + len(s) + 1 > size:
            if held:
                out.append(" ".join(held))
            keep = len(held)
            while keep and length(held[keep - 1 :]) <= overlap:
                keep -= 1
            held = held[keep:]
            if len(s) > size:
                out.extend(_slices(s, size))
                held = []
                continue
        held.append(s)
    if held:
        out.append(" ".join(held))
    return [c for c in out if c.strip()]


#: Rows that a kernel takes of an Arrow batch at a time, so that the pieces of a whole batch are never held together.
SLICE_ROWS = 256


def _chunked(rows: DataFrame, text: str, fn, args: tuple, number: str, piece: str) -> DataFrame:
    """The other columns of *rows*, then *number* and *piece* for each piece that *fn* cuts of *text*."""
    other = [c for c in rows.columns if c != text]
    fields = [*(rows.schema[c] for c in other), StructField(number, IntegerType()), StructField(piece, StringType())]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                cut = [fn(t, *args) for t in part.column(len(other)).to_pylist()]
                at = pa.array([n for n, pieces in enumerate(cut) for _ in pieces], pa.int64())
                made = [pa.array([j for pieces in cut for j in range(len(pieces))], pa.int32()), pa.array([p for pieces in cut for p in pieces], pa.string())]
                kept = [part.column(c).take(at) for c in range(len(other))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*kept, *made], types)], names=[f.name for f in fields])

    return rows.select(*other, text).mapInArrow(run, StructType(fields))


def chunk_documents(docs: DataFrame, size: int = 500, text: str = "text") -> DataFrame:
    """One row per chunk: the other columns of *docs*, chunk_no, text."""
    return _chunked(docs, text, pack_sentences, (size,), "chunk_no", "text")


def chunk_pages(pages: DataFrame, size: int = 800, overlap: int = 120, text: str = "text") -> DataFrame:
    """Overlapping chunks of each page: the other columns of *pages*, chunk, content."""
    return _chunked(pages, text, overlap_passages, (size, overlap), "chunk", "content")
