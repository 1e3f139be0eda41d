import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, similar, simhash


def alike(sets, queries):
    """Brute force: the pairs (i, j) with i in *queries* and a Jaccard similarity of at least 0.8."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i in queries:
        shared = Counter(j for x in sets[i] for j in holders[x])
        yield from ((i, j) for j, n in shared.items() if j != i and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n))


def test_recall_against_all_pairs(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.orderBy("doc_id").collect()
    sets = [frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows]
    component = {r.doc_id: r.component for r in similar.similar_groups(docs).collect()}
    pairs = list(alike(sets, range(len(sets))))
    found = sum(component[rows[i].doc_id] == component[rows[j].doc_id] for i, j in pairs)
    assert len(pairs) > 100 and found >= 0.99 * len(pairs)


@pytest.mark.parametrize("few", [1, 24])
def test_group_of_near_copies_with_strangers(spark, monkeypatch, few):
    """One text with copies at many distances: some are close to a few others only, and share buckets with all."""
    monkeypatch.setattr(similar, "FEW", few)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(150)]
    change = lambda share: " ".join("".join(rng.choices("klmnop", k=7)) if rng.random() < share else w for w in words)
    texts = [change(rng.choice([0.005, 0.02, 0.03, 0.05, 0.08])) for _ in range(220)]
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in alike(sets, range(len(sets))):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in similar.similar_groups(docs).collect():
        got[r.component].add(r.doc_id)
    expect = defaultdict(set)
    for i in range(len(texts)):
        expect[root(i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))
    assert 1 < len(got) < 150


def test_marks_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3200], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])  # 3,200 of 4,400
    x, y = (np.unpackbits(similar.bit_planes(np.concatenate(similar.extremes(s))).view(np.uint8)).reshape(similar.PLANES, -1) for s in (a, b))
    apart = int((x != y).any(axis=0).sum())
    assert abs(apart - 640 * (1 - 3200 / 4400) * 15 / 16) < 40


def test_very_long_and_empty_texts(spark):
    long = " ".join(f"w{i % 9973}x{i % 7919}" for i in range(200_000))
    rows = [(1, long, 1), (2, long + " tail", 2), (3, None, 3), (4, "", 4), (None, "some other words that stand here alone", 5), (5, "some other words that stand here alone", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    out = similar.keep_one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.component for r in out.collect()) == [1, 3, 6]


def test_repeated_line_does_not_hide_a_near_copy(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    body, line = " ".join(word() for _ in range(800)), " ".join(word() for _ in range(12))
    # also below full similarity: a tenth of the body's words replaced at its end
    texts = [f"{body}\n{line}", body + f"\n{line}" * 400, " ".join(body.split()[:720] + [word() for _ in range(80)]) + f"\n{line}" * 400, " ".join(word() for _ in range(800))]
    hashes = [simhash.shingle_hashes(t, similar.SHINGLE) for t in texts]
    sets, prints = [set(h.tolist()) for h in hashes], [simhash.fingerprint(h) for h in hashes]
    assert len(sets[0] & sets[1]) >= 0.95 * len(sets[0] | sets[1])
    assert len(sets[0] & sets[2]) >= 0.8 * len(sets[0] | sets[2])
    assert (prints[0] ^ prints[1]).bit_count() > 24  # repeats move the fingerprint of all shingles
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in similar.similar_groups(docs).collect()}
    assert got[0] == got[1] == got[2] != got[3]
    assert sorted(r.doc_id for r in similar.keep_one_of_each(spark, docs, "").collect()) == [0, 3]


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_texts_that_cannot_be_meant_stay_where_they_are(spark, monkeypatch, bits):
    monkeypatch.setattr(similar, "FILTER_BITS", bits)
    rows = spark.createDataFrame([(None if i == 7 else i, i * i) for i in range(400)], "doc_id long, text_key long")
    keys = rows.filter("doc_id IS NULL OR doc_id % 20 = 0")
    marked = similar._may_hold(rows, keys, "doc_id", "text_key")
    assert marked.columns == ["doc_id", "text_key", "may"]
    got = {r.doc_id: r.may for r in marked.collect()}
    wanted = {None, *range(0, 400, 20)}
    assert len(got) == 400 and all(got[d] for d in wanted)
    assert similar._filter(keys, "doc_id", "text_key").count() <= max(1, bits // 64)
    if bits > 64:
        assert sum(got.values()) <= len(wanted) + 2
    # the stage keeps the same rows however many bits there are, repeated and null ones too
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    docs = spark.createDataFrame([(i, words(i % 25)) for i in range(60)] + [(3, words(3)), (None, words(2)), (None, words(99))], "doc_id long, text string")
    out = similar.keep_one_of_each(spark, docs, "")
    assert sorted(((r.doc_id is None, r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(False, i, words(i)) for i in range(25)] + [(True, None, words(99))], key=str)


def test_simhash_blocks_find_near_copies(spark, monkeypatch):
    """Without a shared band, copies whose fingerprints are within four bits are found by the pigeonhole blocks alone."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(600)]
        texts += [" ".join(words), " ".join(words[:-1] + [word()]), " ".join([word()] + words)]
    texts += [" ".join(word() for _ in range(600)) for _ in range(20)]
    sets = [set(simhash.shingle_hashes(t, similar.SHINGLE).tolist()) for t in texts]
    prints = [simhash.fingerprint(np.array(sorted(s), dtype=np.uint64)) for s in sets]
    close = [(i, j) for i, j in alike(sets, range(len(sets))) if (prints[i] ^ prints[j]).bit_count() <= similar.RADIUS]
    assert len(close) >= 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketches = similar.sketches
    apart = F.transform("bands", lambda b, i: F.xxhash64("row", i))
    monkeypatch.setattr(similar, "sketches", lambda d: sketches(d).withColumn("bands", apart))
    got = {r.doc_id: r.component for r in similar.similar_groups(docs).collect()}
    assert all(got[i] == got[j] for i, j in close)
    assert len({got[i] for i in range(36, 56)}) == 20
    # fingerprints only propose: where all are equal, the exact similarity still decides
    monkeypatch.setattr(similar, "sketches", lambda d: sketches(d).withColumn("fp", F.lit(0).cast("long")))
    got = {r.doc_id: r.component for r in similar.similar_groups(docs).collect()}
    assert [len({got[i] for i in range(k, k + 3)}) for k in range(0, 36, 3)] == [1] * 12 and len(set(got.values())) == 32


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_few_rows_are_dealt_out_and_none_is_lost(spark, monkeypatch, bits):
    monkeypatch.setattr(similar, "FILTER_BITS", bits)
    held = []
    may_hold = similar._may_hold
    monkeypatch.setattr(similar, "_may_hold", lambda *a: held.append(may_hold(*a)) or held[-1])
    rows = spark.createDataFrame([(i, bytes([i % 150]), i * 3) for i in range(200)], "row long, set_id binary, n long")
    firsts = rows.groupBy("set_id").agg(F.min("row").alias("node"))
    nodes = similar._one_of_each_set(rows, firsts)
    assert sorted((r.node, r.n) for r in nodes.collect()) == [(i, i * 3) for i in range(150)]
    wanted = spark.createDataFrame([(i, "x") for i in range(0, 300, 50)], "node long, more string")
    assert sorted((r.node, r.more, r.n) for r in similar._of_nodes(nodes, wanted).collect()) == [(i, "x", i * 3) for i in (0, 50, 100)]
    sets = spark.createDataFrame([(i, [10 * i // 2, 1, 2, 3, 4, 5, 6, 7, 8, 9] if i < 6 else [i]) for i in range(500)], "node long, hashes array<long>")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (7, 8)], "a long, b long")
    assert sorted((r.a, r.b) for r in similar._verified(pairs, sets).collect()) == [(0, 1), (2, 3)]
    # of 200 rows 50 are later ones, of 150 nodes 3 are wanted, of 500 sets 6 are in pairs
    if bits > 64:
        assert [h.filter("may").count() for h in held] == [50, 3, 6]


def test_finished_queries_are_let_go(spark, monkeypatch):
    """The driver of a long session kept shuffles and freed native memory of every round until its limit."""
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    for i in range(5):
        spark.range(50).groupBy((F.col("id") % 7 + i).alias("k")).count().collect()
    held = shuffles()
    ends = time.time() + 20
    while shuffles() > held - 5 and time.time() < ends:  # Python's last references and Spark's cleaner have threads of their own
        assert common.release(spark)  # the JVM of the tests can return native memory
        time.sleep(0.2)
    assert shuffles() <= held - 5
    calls, release = [], common.release
    monkeypatch.setattr(common, "release", lambda s: calls.append(release(s)))
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 25}x{j}" for j in range(30)) + " end" * (i % 2)) for i in range(60)], "doc_id long, text string")
    similar.keep_one_of_each(spark, docs, "")
    assert len(calls) >= 5 and all(calls)
