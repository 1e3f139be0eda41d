"""Cost-balanced packing of token ids into fixed-length training sequences.

A task packs the documents it reads in groups of bounded size, so no text is shuffled.  A sequence's cost is
``length + quadratic * length^2`` summed over its pieces (attention does not cross documents).  Pieces go, longest
first, to the sequence of lowest cost with capacity left; what does not fit there continues in the next one.
A group's tokens fill its sequences exactly; the rest joins the next group.  A task's last rest is laid
out in sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokenize import encoder

CAPACITY = 2048
#: Cost of attention relative to the linear part, per pair of tokens.
QUADRATIC = 1.0 / 1024
#: Ids a task packs at a time: bounds its memory, whatever the partition's size.
GROUP_IDS = 1 << 21

PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"


def cost(length: int, quadratic: float = QUADRATIC) -> float:
    return length + quadratic * length * length


def assign(pieces: list[tuple[int, int, int]], full: int, capacity: int, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Place (doc, start, length) pieces, longest first, in *full* sequences of *capacity*.

    Returns (doc, start, length, sequence, offset) rows and the pieces left when every sequence is full.
    """
    heap = [(0.0, s, capacity) for s in range(full)]
    placed, left = [], []
    for doc, start, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while length and heap:
            spent, s, room = heapq.heappop(heap)
            n = min(room, length)
            placed.append((doc, start, n, s, capacity - room))
            start, length, room = start + n, length - n, room - n
            if room:
                heapq.heappush(heap, (spent + cost(n, quadratic), s, room))
        if length:
            left.append((doc, start, length))
    return placed, left


def pack_group(pieces: list[tuple[int, int, int]], capacity: int, quadratic: float, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """(placed, left over, sequences used).  Only the last group lays out its rest, in powers of two."""
    placed, rest, used = [], [], 0
    for doc, start, length in pieces:
        while length >= capacity:  # a long document's full sequences
            placed.append((doc, start, capacity, used, 0))
            start, length, used = start + capacity, length - capacity, used + 1
        if length:
            rest.append((doc, start, length))
    full = sum(p[2] for p in rest) // capacity
    got, left = assign(rest, full, capacity, quadratic)
    placed += [(d, a, n, s + used, o) for d, a, n, s, o in got]
    used += full
    if last:
        total = sum(p[2] for p in left)
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                got, left = assign(left, 1, 1 << bit, quadratic)
                placed += [(d, a, n, used, o) for d, a, n, _, o in got]
                used += 1
    return placed, left, used


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, quadratic: float = QUADRATIC, group_ids: int = GROUP_IDS) -> DataFrame:
    """Pieces of every document of ``doc_id, text``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one *end_id*; repeated rows are packed as rows of their own; an empty table has no pieces;
    extra columns are ignored; texts of any length are cut, with memory in proportion to the longest.  sequence_id counts
    from 0 without gaps.
    """

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        docs_held: list[tuple[int | None, bytes]] = []
        pieces: list[tuple[int, int, int]] = []
        held = sequences = 0

        def flush(last: bool):
            nonlocal docs_held, pieces, held, sequences
            placed, left, used = pack_group(pieces, capacity, quadratic, last)
            columns = [[], [], [], [], [], [], []]
            for i, start, n, s, offset in placed:
                doc_id, data = docs_held[i]
                for c, x in zip(columns, (doc_id, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(data) // 4, sequences + s, offset)):
                    c.append(x)
            sequences += used
            keep = sorted({p[0] for p in left})
            new = {old: i for i, old in enumerate(keep)}
            docs_held, pieces = [docs_held[i] for i in keep], [(new[d], a, n) for d, a, n in left]
            held = sum(len(x) // 4 for _, x in docs_held)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(placed), part, dtype=np.int32)), *(pa.array(c, pa.int64()) for c in columns)], names=["part", *names])

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), enc.ids_of(batch.column(1).to_pylist())):
                data += end
                pieces.append((len(docs_held), 0, len(data) // 4))
                docs_held.append((doc_id, data))
                held += len(data) // 4
                if held >= group_ids:
                    yield from flush(False)
                    held = min(held, group_ids - 1)  # a carried rest of a very long document is no reason to flush
        yield from flush(True)

    spark = docs.sparkSession
    placed = common.materialize(docs.select("doc_id", "text").mapInArrow(run, PIECES), "packed")
    # one row per task, whatever the rows; the window and the broadcast are of that size
    sizes = placed.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return placed.join(F.broadcast(base), "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of :func:`pack` for the documents that are left."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
