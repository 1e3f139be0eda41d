"""Token ids in word-aligned Simple-8b segments.

A segment is self-contained bytes: magic, counts, document table (id, ids), block offsets, 64-bit words
and escapes.  Each word holds a 4-bit selector over 60 payload bits:

* selectors 2-15 pack 60x1, 30x2, 20x3, 15x4, 12x5, 10x6, 8x7, 7x8, 6x10, 5x12, 4x15, 3x20, 2x30, 1x60 bits,
* selector 0 is a run of 240 zeros,
* selector 1 is an escape: its payload indexes the segment's table of raw 64-bit values.

Every block of ``BLOCK`` ids starts at a word of its own whose offset is stored, so a decoder unpacks all
words of one selector at once, in any block order.  Segments travel as a binary column of Parquet files:
Spark's committer makes the write atomic and any Hadoop store can hold them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokenize import encoder

MAGIC = 0x31423853  # "S8B1"
BLOCK = 8192
#: Ids after which a segment is closed at the next document's end.
SEGMENT_IDS = 1 << 19
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
_WIDTH = np.array([i.bit_length() for i in range(1 << 17)], dtype=np.uint8)
_SHIFTS = {k: (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64) for k in range(2, 16)}

SEGMENTS = "shard int, segment int, start long, n_docs long, n_ids long, payload binary"
DOCS = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    top = int(ids.max()) if len(ids) else 0
    if top < len(_WIDTH):
        return _WIDTH[ids.astype(np.int64)]
    out = np.zeros(len(ids), dtype=np.uint8)
    if top < 1 << 52:
        np.copyto(out, np.frexp(ids.astype(np.float64))[1], casting="unsafe")
        return out
    for b in range(64):
        out[ids >= np.uint64(1 << b)] = b + 1
    return out


def encode_block(ids: np.ndarray, escapes: list[int]) -> np.ndarray:
    """Words of up to BLOCK unsigned 64-bit ids; values of over 60 bits go to *escapes*."""
    n = len(ids)
    width = np.zeros(n + 240, dtype=np.uint8)
    width[:n] = _widths(ids)
    top = {1: width}

    def over(a: int, b: int) -> None:
        """Largest width in each run of a+b from those of a and b."""
        x, y = top[a], top[b]
        top[a + b] = np.maximum(x[: len(x) - b], y[a : a + len(x) - b])

    for a, b in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (8, 2), (8, 4), (8, 7), (15, 5), (15, 15), (30, 30), (60, 60), (120, 120)):
        over(a, b)
    selector = np.full(n, 1, dtype=np.uint8)
    for k in range(15, 1, -1):
        np.putmask(selector, top[int(COUNTS[k])][:n] <= BITS[k], k)
    np.putmask(selector, top[240][:n] == 0, 0)
    follow = (np.arange(n) + COUNTS[selector]).tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i = follow[i]
    at = np.array(at, dtype=np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.zeros(n + 240, dtype=np.uint64)
    padded[:n] = ids
    for k in np.unique(chosen):
        rows = np.flatnonzero(chosen == k)
        if k == 0:
            continue
        if k == 1:
            for r in rows:
                words[r] |= np.uint64(len(escapes))
                escapes.append(int(ids[at[r]]))
            continue
        values = padded[at[rows][:, None] + np.arange(COUNTS[k])]
        words[rows] |= np.bitwise_or.reduce(values << _SHIFTS[int(k)], axis=1)
    return words


def encode_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a segment: *counts* ids for each of *doc_ids*, one after the other in *ids*."""
    ids = ids.astype(np.uint64, copy=False)
    escapes: list[int] = []
    blocks = [encode_block(ids[i : i + BLOCK], escapes) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = np.array([MAGIC, len(doc_ids), len(ids), len(blocks), len(escapes)], dtype="<u8")
    body = [head, np.asarray(doc_ids, dtype="<i8"), np.asarray(counts, dtype="<u8"), offsets, *blocks, np.array(escapes, dtype="<u8")]
    return b"".join(x.tobytes() for x in body)


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a segment; all words of one selector are unpacked at once."""
    raw = np.frombuffer(data, dtype="<u8")
    magic, n_docs, n_ids, n_blocks, n_escapes = (int(x) for x in raw[:5])
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    doc_ids, counts = raw[5 : 5 + n_docs].view("<i8"), raw[5 + n_docs : 5 + 2 * n_docs].astype(np.int64)
    at = 5 + 2 * n_docs
    offsets = raw[at : at + n_blocks + 1].astype(np.int64)
    at += n_blocks + 1
    n_words = int(offsets[-1]) if n_blocks else 0
    words, escapes = raw[at : at + n_words], raw[at + n_words : at + n_words + n_escapes]
    selector = (words >> np.uint64(60)).astype(np.int64)
    before = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    block = np.repeat(np.arange(n_blocks), np.diff(offsets))
    room = BLOCK + 240  # the last word of a block may run over
    start = before - before[offsets[:-1]][block] + block * room if n_words else before
    out = np.zeros(n_blocks * room, dtype=np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for k in range(1, 16):
        rows = np.flatnonzero(selector == k)
        if not len(rows):
            continue
        if k == 1:
            out[start[rows]] = escapes[payload[rows].astype(np.int64)]
        else:
            out[start[rows][:, None] + np.arange(COUNTS[k])] = (payload[rows][:, None] >> _SHIFTS[k]) & np.uint64((1 << int(BITS[k])) - 1)
    return doc_ids, counts, out.reshape(n_blocks, room)[:, :BLOCK].reshape(-1)[:n_ids]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``doc_id, text`` in ascending doc_id order (ties by a hash of the text) into segment files under *path*.

    Null texts are empty; an empty text still gets *end_id*.  A null doc_id is written as -2^63 and read back
    as null.  Extra columns are ignored.  Documents are range-partitioned by both, so shard numbers follow doc_id and rows of
    one doc_id can be split.  An empty table gives no files with rows; texts of any length are encoded whole.
    """

    def run(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, doc_ids, counts, held, segment, start = [], [], [], 0, 0, 0

        def close():
            nonlocal ids, doc_ids, counts, held, segment, start
            payload = encode_segment(np.array(doc_ids, dtype=np.int64), np.array(counts), np.frombuffer(b"".join(ids), dtype="<u4"))
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())],
                names=["shard", "segment", "start", "n_docs", "n_ids", "payload"],
            )
            ids, doc_ids, counts, segment, start, held = [], [], [], segment + 1, start + held, 0
            return row

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), enc.ids_of(batch.column(1).to_pylist())):
                got += end
                ids.append(got)
                doc_ids.append(-(1 << 63) if doc_id is None else doc_id)
                counts.append(len(got) // 4)
                held += len(got) // 4
                if held >= segment_ids:
                    yield close()
        if doc_ids:
            yield close()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: shard, doc_id, start in the shard, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for shard, start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc_ids, counts, ids = decode_segment(payload.as_py())
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc_ids), shard, dtype=np.int32)),
                        pa.array([None if d == -(1 << 63) else d for d in doc_ids.tolist()], pa.int64()),
                        pa.array(start + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spark.read.schema(SEGMENTS).parquet(path).select("shard", "start", "payload").mapInArrow(run, DOCS)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
    shards = spark.read.schema(SEGMENTS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    # one row per write task, whatever the rows; the window and the broadcast are of that size
    base = shards.select("shard", (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("base"))
    return (
        read_token_files(spark, path)
        .join(F.broadcast(base), "shard")
        .select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "shard")
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch_path(spark, "token-files")
    write_token_files(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path)
