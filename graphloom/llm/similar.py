"""Near-duplicates at a shingle similarity of 0.8 or more, for the corpus pipeline.

Candidates come first from SimHash: fingerprints of the distinct shingles, linked within RADIUS bits by the pigeonhole
blocks of :mod:`simhash`.  At similarity 0.8 about ten of 64 bits differ, and blocks for that radius are four bits
long: every bucket would hold a sixteenth of the corpus.  So the pairs beyond RADIUS come from min-wise bands over the same shingle
hashes (a pair of similarity 0.8 misses all bands once in 1,500).  The exact Jaccard similarity of the shingle sets decides
on every candidate of either kind whose set sizes allow it.

Texts with equal shingle sets are one node from the start.  Nodes that already belong together are never compared.  Then, in
each round a bucket whose nodes outside its largest component are few compares those with all its nodes and is done; any other
one compares a few pivots, the nodes that meet most others over all bands, with all its nodes, and drops them.
Components are contracted between rounds and both numbers grow geometrically, so a group of copies costs work in proportion
to its size, and a bucket of strangers still has every pair compared, in a number of rounds that is logarithmic.

Comparing means four bits of each of the 320 minima and 320 maxima, inside the join: only pairs that differ in at most
``APART`` of them are formed and verified exactly.  At similarity 0.8 a pair differs in 120 on average; more than ``APART``
has a chance of about one in 50,000, which is small beside what the bands miss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import close_links, fingerprint, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bits within which fingerprints are linked by blocks.
RADIUS = 4
BANDS, ROWS = 40, 8
#: Nodes outside a bucket's largest component that are compared with all its nodes at once, in the first round.
FEW = 24
#: Of the minima and maxima, how many may differ in their four marked bits.
APART = 161
PLANES = 4
#: Bits, 64 to a row, of the broadcast table that tells which rows a join of texts can leave where they are.
FILTER_BITS = 1 << 24
_WORDS = 2 * BANDS * ROWS // 64
_DRAW = np.random.default_rng(20240601)
_A = (_DRAW.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = _DRAW.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

SKETCH = "row long, doc_id long, text_key long, set_id binary, n long, fp long, bands array<long>, marks array<long>"


def extremes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of the hashes under each of the BANDS * ROWS orders."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(BANDS * ROWS, dtype=np.uint32)
    for i in range(0, len(folded), 1024):
        # multiply, then xor-shift: low bits alone would order alike for all multipliers
        x = folded[i : i + 1024, None] * _A + _B
        x ^= x >> np.uint32(15)
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return low, high


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its minima, mixed; keys of different bands differ but for chance."""
    mixed = (low.astype(np.uint64) * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """PLANES bits of every value, plane by plane, 64 to a word.  Bits of mixed values: extremes are alike at one end."""
    mixed = values * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(16)
    bits = (mixed[None, :] >> np.arange(PLANES, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<i8").reshape(-1)


def _apart(a: str, b: str) -> Column:
    """Extremes whose marked bits differ."""
    total = F.lit(0)
    for w in range(_WORDS):
        differ = F.lit(0).cast("bigint")
        for p in range(PLANES):
            i = p * _WORDS + w
            differ = differ.bitwiseOR(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
        total = total + F.bit_count(differ)
    return total


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: row number (stable once written), doc_id, text_key, set_id (128-bit digest of the shingle set), set size, fingerprint, band keys."""

    def run(batches):
        import xxhash

        row = TaskContext.get().partitionId() << 36
        for batch in common.slices(batches):
            sets, sizes, prints, bands, marks = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                distinct = np.unique(shingle_hashes(text, SHINGLE))
                low, high = extremes(distinct)
                sets.append(xxhash.xxh3_128_digest(distinct.tobytes()))
                sizes.append(len(distinct))
                prints.append(fingerprint(distinct))
                bands.append(band_keys(low))
                marks.append(bit_planes(np.concatenate([low, high])))
            rows = pa.array(np.arange(row, row + len(sets), dtype=np.int64))
            row += len(sets)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, marks))],
                names=["row", "doc_id", "text_key", "set_id", "n", "fp", "bands", "marks"],
            )

    return docs.select("doc_id", _text_key().alias("text_key"), "text").mapInArrow(run, SKETCH)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _bits(*columns: str) -> tuple[Column, Column]:
    """Row and place of the bit of a key in the table of :func:`_filter`."""
    at = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def _filter(keys: DataFrame, *columns: str) -> DataFrame:
    """filter_row, filter_mask: the bits of all *keys*, in at most FILTER_BITS / 64 rows whatever their number."""
    row, place = _bits(*columns)
    return keys.select(row.alias("filter_row"), place.alias("place")).groupBy("filter_row").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("filter_mask"))


def _may_hold(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """*rows* with ``may``: false only where no key of *keys* agrees in *columns*.  No row is moved."""
    row, place = _bits(*columns)
    table = F.broadcast(_filter(keys, *columns))
    met = rows.withColumn("filter_row", row).withColumn("filter_place", place).join(table, "filter_row", "left")
    may = F.coalesce(F.getbit("filter_mask", F.col("filter_place")) == 1, F.lit(False))
    return met.withColumn("may", may).drop("filter_row", "filter_place", "filter_mask")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes of the nodes in *wanted* (node, doc_id, text_key), from their texts."""

    def run(batches):
        for batch in common.slices(batches):
            sets = [np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = _may_hold(docs.select("doc_id", "text", _text_key().alias("text_key")), wanted, "doc_id", "text_key").filter("may")
    chosen = texts.join(wanted, (texts.doc_id.eqNullSafe(wanted.doc_id)) & (texts.text_key == wanted.text_key)).select("node", "text")
    return chosen.mapInArrow(run, "node long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of *pairs* (a, b, ...; read twice) whose shingle sets have the similarity; repeats in *sets* are harmless."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = _may_hold(sets, ends, "node").filter("may").drop("may")  # sets of no pair are not dealt out
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    alike = both.select(*pairs.columns, shared.alias("shared"), (F.size("hashes_a") + F.size("hashes_b")).alias("sizes"))
    return alike.filter(F.col("shared") >= SIMILARITY * (F.col("sizes") - F.col("shared"))).select(*pairs.columns)


def _one_of_each_set(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The *rows* that are the first of their set_id, as ``node``; only those that may be later ones are dealt out."""
    later = rows.select("row", "set_id").join(firsts, "set_id").filter("row <> node").select("row")
    later = common.materialize(later, "later")
    marked = _may_hold(rows, later, "row")
    first = marked.filter("NOT may").unionByName(marked.filter("may").join(later, "row", "left_anti"))
    return first.drop("may").withColumnRenamed("row", "node")


def _of_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """*wanted* joined with *nodes*, of which only those that may be wanted are dealt out."""
    return wanted.join(_may_hold(nodes, wanted, "node").filter("may").drop("may"), "node")


def _near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of *nodes* (node, fp) whose fingerprints are within RADIUS bits: enough to hold each group of them together."""
    prints = common.materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = nodes.join(prints, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, other = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    close = close_links(prints.select("fp"), RADIUS).join(one, "a").join(other, "b")
    return equal.unionByName(close.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def _asking(members: DataFrame, pivots: int, few: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, n, component) rows to compare with all of their bucket, and the keys that need another round.

    Every aggregation is over single rows with partial sums, so a bucket that holds a third of all nodes is no hot task.
    """
    groups = common.materialize(members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")), "groups")
    buckets = groups.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("top"))
    buckets = buckets.filter("m > top.c").select("key", F.col("top.component").alias("top"), (F.col("m") - F.col("top.c") <= few).alias("last"))
    buckets = common.materialize(buckets, "buckets")
    inside = members.join(buckets, "key")
    rest = inside.filter("last AND component <> top").select("key", "node")
    slot = F.pmod(F.xxhash64("node"), F.lit(pivots))
    best = inside.filter("NOT last").groupBy("key", slot.alias("slot")).agg(F.max(F.struct("hub", "node")).alias("best"))
    return rest.unionByName(best.select("key", F.col("best.node").alias("node"))), buckets


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, component) for each row of *docs*; component is a number of this call.  *docs* is read twice."""
    rows = common.materialize(sketches(docs), "sketches")
    firsts = common.materialize(rows.groupBy("set_id").agg(F.min("row").alias("node")), "sets")
    nodes = _one_of_each_set(rows, firsts)
    banded = nodes.filter("n > 0").select("node", "n", F.explode("bands").alias("key"))
    banded = common.materialize(banded, "bands")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = common.materialize(banded.join(sizes, "key"), "shared")
    hubs = common.materialize(shared.groupBy("node").agg(F.sum("size").alias("hub")), "hubs")
    common.release(docs.sparkSession)
    near = common.materialize(_near_prints(nodes.filter("n > 0").select("node", "fp")), "near")
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
    asked = common.materialize(hubs.select("node").unionByName(ends).distinct(), "asked")
    wanted = common.materialize(_of_nodes(nodes.select("node", "doc_id", "text_key"), asked), "wanted")
    sets = common.materialize(_shingle_sets(docs, wanted), "shingle-sets")
    common.release(docs.sparkSession)
    start = components(common.materialize(_verified(near, sets), "similar"), "a", "b")
    classes = asked.join(start, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    classes = common.materialize(classes, "classes")
    marks = common.materialize(_of_nodes(nodes.select("node", "marks"), hubs.select("node")), "marks")
    members = shared.join(hubs.join(classes, "node"), "node").select("key", "node", "n", "hub", "component")
    members = common.materialize(members, "members")
    pivots, few = 1, FEW
    while True:
        common.release(docs.sparkSession)  # each round plans a few dozen queries
        asking, buckets = _asking(members, pivots, few)
        asking = common.materialize(asking.withColumn("asks", F.lit(True)), "asking")
        if asking.isEmpty():
            break
        opened = members.join(buckets.select("key", "last"), "key").join(asking, ["key", "node"], "left")
        opened = common.materialize(opened.withColumn("asks", F.coalesce("asks", F.lit(False))), "opened")
        told = opened.join(marks, "node")  # marks are ten times the rest: they come last
        left = told.filter("asks").select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"), F.col("marks").alias("m_a"))
        right = told.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), F.col("marks").alias("m_b"), "asks")
        plausible = F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
        once = (F.col("c_a") != F.col("c_b")) & (~F.col("asks") | (F.col("a") < F.col("b")))
        pairs = left.join(right, "key").filter(plausible & once & (_apart("m_a", "m_b") <= APART)).select("a", "b", "c_a", "c_b").distinct()
        links = common.materialize(_verified(common.materialize(pairs, "pairs"), sets), "similar")
        common.release(docs.sparkSession)
        merged = common.materialize(components(links, "c_a", "c_b").withColumnRenamed("component", "to").withColumnRenamed("node", "component"), "merged")
        named = lambda t: t.join(merged, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
        classes = common.materialize(named(classes), "classes")
        members = named(opened.filter("NOT last AND NOT asks").select("key", "node", "n", "hub", "component"))
        members = common.materialize(members, "members")
        pivots, few = pivots * 4, few * 16
    classes = classes.withColumnRenamed("component", "class")
    out = firsts.join(classes, "node", "left").select("set_id", F.coalesce("class", "node").alias("component"))
    return rows.select("doc_id", "text_key", "set_id").join(common.materialize(out, "classes"), "set_id").select("doc_id", "text_key", "component")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of exact and near copies the row of smallest doc_id, in the columns of *docs*.

    Texts without words (null and empty ones too) are one group; identical rows are one row; nulls in doc_id come last; texts
    of any length are read whole, with memory in proportion to the longest; an empty table stays empty; other columns,
    whatever their names, pass through.
    """
    common.release(spark)
    grouped = common.materialize(similar_groups(docs), "groups")
    common.release(spark)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = grouped.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key"))
    kept = common.materialize(kept, "kept")
    stay = lambda t: t.join(kept, t.doc_id.eqNullSafe(kept.kept_id) & (t.text_key == kept.kept_key), "left_semi")
    lost = grouped.join(kept, grouped.doc_id.eqNullSafe(kept.kept_id) & (grouped.text_key == kept.kept_key), "left_anti")
    lost = common.materialize(lost.select("doc_id", "text_key"), "lost")
    packed = docs.select(F.struct("*").alias("row"), "doc_id", _text_key().alias("text_key"))
    # rows that are surely not lost stay where they are
    marked = _may_hold(packed, lost, "doc_id", "text_key")
    stays = marked.filter("NOT may").unionByName(stay(marked.filter("may")))
    repeated = not grouped.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
    if repeated:  # rows that agree in doc_id and text
        stays = stays.dropDuplicates(["doc_id", "text_key"])
    return stays.select("row.*")
