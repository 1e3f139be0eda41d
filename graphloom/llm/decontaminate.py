"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

A window is as many words as a benchmark item.  Only windows that share a shingle with an item of their length can reach
the similarity, so the others are not fingerprinted (running sums of the bit counts give each window's in constant time).
The index splits item fingerprints into blocks; a fingerprint within *radius* bits of an item is within
radius/blocks bits of it in some block, so looking up all block values that near finds every item within the radius.
These are the candidates; the exact weighted-shingle (multiset) similarity verifies them.

The benchmark is read in slices of bounded size, each broadcast to one pass over the documents.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import fingerprint

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 about 10 of 64 bits differ, 3 being one standard deviation.  23 is what lookups within two bits of eight blocks guarantee.
RADIUS = 23
BLOCKS = 8
#: Characters of benchmark text that one pass broadcasts: about 120 MB of index in each worker, measured.
SLICE_CHARS = 2_000_000

#: Window starts fingerprinted at a time: bounds the memory of a text of any length.
_STRETCH = 4096

HITS = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(bytes.maketrans(*common.LOWER)).split()


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def _hashes(shingles: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


class HammingIndex:
    """Finds all stored fingerprints within *radius* bits."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.fps, self.radius = fps, radius
        self.edges = [64 * i // blocks for i in range(blocks + 1)]
        self.near = radius // blocks
        self.tables = []
        for a, b in zip(self.edges, self.edges[1:]):
            values = ((fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            rows: dict[int, list[int]] = {}
            for i, v in enumerate(values.tolist()):
                rows.setdefault(v, []).append(i)
            flips = [sum(1 << i for i in c) for k in range(self.near + 1) for c in combinations(range(b - a), k)]
            self.tables.append((a, (1 << (b - a)) - 1, rows, flips))

    def query(self, fp: int) -> list[tuple[int, int]]:
        """(distance, position) of the fingerprints within the radius."""
        found: set[int] = set()
        for shift, mask, rows, flips in self.tables:
            value = fp >> shift & mask
            for f in flips:
                found.update(rows.get(value ^ f, ()))
        distance = lambda i: (fp ^ int(self.fps[i])).bit_count()
        return sorted((d, i) for i in found if (d := distance(i)) <= self.radius)


class BenchmarkIndex:
    """Items of one slice: shingle weights, fingerprints, and which items hold a shingle."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.shingle, self.similarity = shingle, similarity
        self.ids, self.weights, self.lengths, fps = [], [], [], []
        self.vocabulary: dict[bytes, int] = {}
        self.holders: dict[bytes, set[int]] = {}  # shingle -> lengths of the items that hold it
        self.shortest = shingle
        for item_id, text in items:
            words = _words(text)
            if not words:
                continue
            shingles = _shingles(words, shingle)
            for s in shingles:
                self.holders.setdefault(s, set()).add(len(words))
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
            self.shortest = min(self.shortest, len(words))
            self.ids.append(item_id)
            self.weights.append(Counter(shingles))
            self.lengths.append(len(words))
            fps.append(fingerprint(_hashes(shingles)))
        self.hamming = HammingIndex(np.array(fps, dtype=np.uint64), radius)

    def anchors(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """Item length -> merged ranges of window starts that take in a shingle shared with an item of that length."""
        known = np.fromiter(map(self.vocabulary.__contains__, words), dtype=bool, count=len(words))
        found: dict[int, list[tuple[int, int]]] = {}
        size = min(self.shingle, len(words))
        if not size or not known.any():
            return found
        runs = np.concatenate([[0], np.cumsum(known)])
        for size in sorted({size, *(n for n in range(self.shortest, self.shingle) if n < len(words))}):
            for at in np.flatnonzero(runs[size:] - runs[:-size] == size).tolist():
                for full in self.holders.get(b" ".join(words[at : at + size]), ()):
                    length = min(full, len(words))
                    first, last = max(0, at - length + min(size, length)), min(at, len(words) - length)
                    ranges = found.setdefault(full, [])
                    if ranges and first <= ranges[-1][1] + 1 and first >= ranges[-1][0]:
                        ranges[-1] = (ranges[-1][0], max(last, ranges[-1][1]))
                    elif first <= last:
                        ranges.append((first, last))
        return found

    def hits(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item_id, start word, words, similarity) of each item that some window holds: its closest window by fingerprint that verifies."""
        words = _words(text)
        candidates: dict[int, list[tuple[int, int]]] = {}
        for full, ranges in self.anchors(words).items():
            length = min(full, len(words))
            size = min(self.shingle, length)
            per = length - size + 1
            for first, last in ranges:
                for low in range(first, last + 1, _STRETCH):
                    high = min(last, low + _STRETCH - 1)
                    shingles = _shingles(words[low : high + length], size)
                    bits = np.unpackbits(_hashes(shingles).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
                    fps = np.packbits((sums[per:] - sums[:-per]) * 2 > per, axis=1, bitorder="little").view("<u8")[:, 0]
                    near = {fp: self.hamming.query(fp) for fp in set(fps.tolist())}
                    for s, fp in enumerate(fps.tolist(), low):
                        for d, i in near[fp]:
                            if self.lengths[i] == full:
                                candidates.setdefault(i, []).append((d, s))
        out = []
        for i, met in candidates.items():
            length, weights = min(self.lengths[i], len(words)), self.weights[i]
            for _, s in sorted(set(met)):
                window = Counter(_shingles(words[s : s + length], self.shingle))
                if weighted_similarity(window, weights) >= self.similarity:
                    out.append((self.ids[i], s, length, weighted_similarity(window, weights)))
                    break
        return out


def _slices(spark: SparkSession, items: DataFrame):
    """Broadcast indexes of the benchmark, each of bounded size."""
    items = items.select("item_id", "text").filter(F.col("text").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // SLICE_CHARS))
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield spark.sparkContext.broadcast(BenchmarkIndex([tuple(r) for r in part.collect()]))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: one row for each document row and item that it holds.

    Null or empty texts and items hold nothing; equal items are each reported; a text shorter than an item is
    one window; repeated document rows are reported each; extra columns are ignored; an empty table of either kind gives an
    empty result; texts of any length are read whole, fingerprints in stretches of bounded size.
    """
    spark = docs.sparkSession
    found = None
    for index in _slices(spark, items):

        def run(batches, index=index):
            for batch in common.slices(batches):
                rows = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in index.value.hits(t)]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, HITS)
        found = part if found is None else found.unionByName(part)
    return found


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of *docs* that hold no item, all columns kept; no row is moved.  Rows of null or empty text stay."""
    for index in _slices(docs.sparkSession, items):
        at = docs.columns.index("text")

        def run(batches, index=index):
            for batch in common.slices(batches):
                clean = pa.array([not index.value.hits(t) for t in batch.column(at).to_pylist()], pa.bool_())
                yield batch.filter(clean)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))
