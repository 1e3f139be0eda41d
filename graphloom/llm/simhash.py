"""SimHash near-duplicates by pigeonhole blocks.

Two fingerprints within *radius* bits agree on at least m of radius+m blocks, so joining on every choice of m blocks
finds each close pair; more blocks are used as the table grows, to keep random meetings rare.  Equal fingerprints
are one node from the start.  Where many different fingerprints share a block choice, pairs are not formed: a
pair within an even radius r has a midpoint within r/2 of both, so each such fingerprint meets the others at the points of its
own r/2-ball, which costs a fixed number of rows per fingerprint and links exactly the same pairs' components.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Different fingerprints under one block choice up to which all their pairs are compared.
BUCKET = 128
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of *size* lower-cased words, repeats included (fewer words: all of them; none: empty)."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(bytes.maketrans(*common.LOWER)).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per row of ``doc_id, text``; null texts have no words."""

    def run(batches):
        for batch in common.slices(batches):
            fp = np.array([fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int, n: int) -> list[int]:
    """Bit masks of all choices of m of radius+m blocks, m the least that leaves under two random meetings per fingerprint."""
    for m in range(1, 9):
        blocks = radius + m
        if comb(blocks, m) * n / 2.0 ** (64 * m // blocks + 1) <= 2:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(parts, m)]


def ball(radius: int) -> list[int]:
    """All bit patterns with up to *radius* ones."""
    return [_signed(sum(1 << i for i in c)) for k in range(radius + 1) for c in combinations(range(64), k)]


def close_links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of *nodes* whose components are those of all pairs within *radius* bits."""
    if radius % 2:
        raise ValueError("radius must be even")
    masks = block_masks(radius, nodes.count())
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.inline(choices)).select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("block"), "fp")
    sizes = rows.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = common.materialize(rows.join(sizes, ["choice", "block"]), "blocks")
    some = shared.filter(F.col("n") <= bucket).select("choice", "block", "fp")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = some.withColumnRenamed("fp", "a").join(some.withColumnRenamed("fp", "b"), ["choice", "block"]).filter((F.col("a") < F.col("b")) & close)
    links = pairs.select("a", "b")
    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    points = F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)]))
    met = crowded.select("fp", points.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    low = F.min("fp").over(Window.partitionBy("point"))
    meetings = met.select("fp", low.alias("b")).filter("fp != b").select(F.col("fp").alias("a"), "b")
    return links.unionByName(meetings).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id per row of ``doc_id, text``.

    component_id is the smallest doc_id reachable over links, its own included.  Rows without words have fingerprint
    zero and link like any other; repeated rows are rows of the same component; extra columns are ignored; an empty
    table gives an empty result; texts of any length are read whole, with memory in proportion to the longest.
    """
    marked = common.materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = common.materialize(components(close_links(nodes, radius, bucket), "a", "b"), "components")
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = common.materialize(named, "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # a table of its own: both sides of the last join are then dealt anew, and a hot fingerprint's rows can be split
    classes = common.materialize(named.join(lowest, "component").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
