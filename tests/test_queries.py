import json

import numpy as np

from graphloom import component_queries, queries
from graphloom.operators import chunking, dedup, extraction
from graphloom.sources import readers


def test_rule_graph_caps_names_per_chunk(spark, tmp_path):
    name = lambda i: "N" + "".join(chr(97 + int(d)) for d in f"{i:03d}")
    # 320 names, one to a line with its follower, over several chunks of under 150 names
    text = "\n".join(f"{name(i)} {name(i + 1)} {'x' * 150}." for i in range(320))
    spark.createDataFrame([(1, text), (2, "Alpha meets Beta."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.subject, r.object) for r in queries.extract_rule_graph(spark, str(tmp_path)).collect()}
    expect = {("Alpha", "Beta")}
    chunks = chunking.pack_sentences(text, readers.Config().chunk_size)
    assert len(chunks) > 1
    for chunk in chunks:
        names = [e["name"] for e in json.loads(extraction.rule_entities(chunk))["entities"]]
        assert len(names) <= extraction.ENTITY_CAP
        expect |= {(r["subject"], r["object"]) for r in json.loads(extraction.rule_relations(chunk, names))["relations"]}
    assert got == expect
    assert {(name(i), name(i + 1)) for i in range(320)} <= got


def test_capacity_clusters_cover_the_table(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (300, 4)), rng.normal(6, 1, (110, 4))]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.item: r.cluster for r in queries.vec_assign_capacity(spark, str(tmp_path)).collect()}
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    centers = [r.center for r in dedup.kmeans_centers(e, 3).orderBy("cluster").collect()]
    assert len(centers) == 410 // 128
    d = np.round(np.sqrt(((x.astype(np.float64)[:, None] - np.array(centers)) ** 2).sum(2)), 9)
    order, load, expect = np.argsort(d, axis=1, kind="stable"), [0] * 3, {}
    for r in range(3):
        for i in range(len(x)):
            k = int(order[i, r])
            if i not in expect and load[k] < 128:
                expect[i] = k
                load[k] += 1
    assert got == {i: expect.get(i, 3) for i in range(len(x))}
    assert sum(c < 3 for c in got.values()) == 384


def test_conversation_graphs_keep_all_names(spark, tmp_path):
    """A conversation of more names than a chunk's cap: every pair of neighbours is in both graphs."""
    words = ["w" * 8 + "".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(400)]
    turns = [(1, 0, "user", " ".join(words[:200])), (1, 1, "assistant", " ".join(words[200:])), (3, 0, "user", "brokenword brokenother")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    # the role of the next line stands between the turns: "assistant" is a long word, too
    line = [*words[:200], "assistant", *words[200:]]
    expect = set(zip(line, line[1:]))
    assert {(r.subject, r.object) for r in component_queries.conv_graph(spark, str(tmp_path)).collect()} == expect | {("brokenword", "brokenother")}
    got = {(r.kind, r.value) for r in component_queries.conv_graph_isolated(spark, str(tmp_path)).collect()}
    assert got == {("triple", f"{a}|{b}") for a, b in expect} | {("failed", "3|no answer")}


def test_greedy_representative_of_a_later_round(spark):
    """4 is next to 2 and to 3; 3 is chosen a round before 2, which follows nobody once 1 has gone to 0."""
    items = spark.createDataFrame([(i,) for i in range(5)], "name int")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 4), (3, 4)], "a int, b int")
    got = {r.item: r.representative for r in dedup.greedy_selection(items, links).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}
