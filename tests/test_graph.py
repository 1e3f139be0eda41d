import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import dedup, extraction, retrieval, sections
from graphloom.plans import analytics
from graphloom.plans.graph import Graph, collapse, merge, rewrite, sink_edges
from graphloom.sources import readers, sinks


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def small(spark):
    e = ["整车物流", "整车运输", "汽车物流", "仓储管理"]
    return Graph.from_rows(spark, e, [("整车物流", "属于", "汽车物流"), ("仓储管理", "属于", "汽车物流")])


def test_statistics_and_components(small):
    s = analytics.statistics(small).first()
    assert (s.n_entities, s.n_triples, s.average_degree, s.density) == (4, 2, 1.0, 0.167)
    assert [r.name for r in analytics.isolated(small).collect()] == ["整车运输"]
    assert sorted({(r.component, r.size) for r in analytics.components(small).collect()}, key=lambda x: -x[1])[0][1] == 3
    assert sum(r.degree for r in analytics.degrees(small).collect()) == 4


def test_components_match_union_find(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(80)]
    t = [(rng.choice(names), "r", rng.choice(names)) for _ in range(60)]
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, _, b in t:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.name: r.component for r in analytics.components(Graph.from_rows(spark, names, t)).collect()}
    assert got == {n: find(n) for n in names}


def test_merge_is_idempotent_and_rewrite_unites(spark, small):
    again = merge([small, small, small])
    assert pairs(again.triples, "subject", "object") == pairs(small.triples, "subject", "object")
    m = spark.createDataFrame([("整车运输", "整车物流")], "name string, canonical string")
    out = rewrite(small, m, spark.createDataFrame([], "name string, canonical string"))
    assert out.entities.count() == 3
    assert collapse(small.triples).count() == 2


def test_sink_needs_both_ends(spark):
    g = Graph(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([], "predicate string"), spark.createDataFrame([("a", "x-y", "b"), ("a", "x y", "b"), ("a", "x", "c")], "subject string, predicate string, object string"))
    assert pairs(sink_edges(g), "subject", "rel_type", "object", "predicate") == [("a", "x_y", "b", "x-y")]


def test_graph_files_round_trip(spark, small, tmp_path):
    sinks.write_graph(small, str(tmp_path / "g"))
    assert sinks.read_graph(spark, str(tmp_path / "g")).stats().first().n_triples == 2
    sinks.write_graph_json(small, str(tmp_path / "j"))
    assert readers.graph_json(spark, str(tmp_path / "j")).stats().first().n_entities == 4


def test_clean_sections(spark):
    rows = ["前言", "第一章 概论", "1.1 起点", "实训项目", "无编号", "2.1 正文", "思 考 题", "3.1 末"]
    df = spark.createDataFrame([("d", i, h, 1, "c\n[1] 某 出版社\nz" if i == 2 else "c\n") for i, h in enumerate(rows)], "doc_id string, section int, heading string, level int, content string")
    got = sections.clean(df).orderBy("section").collect()
    assert [r.heading for r in got] == ["第一章 概论", "1.1 起点", "2.1 正文", "3.1 末"]
    assert got[1].content == "c"


def test_decayed_subgraph_matches_queue(spark):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(20)]
    edges = sorted({(rng.choice(names), "r", rng.choice(names)) for _ in range(30)})
    seeds = [("n1", 0.9), ("n2", 0.5), ("n3", -0.1)]
    score, depth, todo, best = dict(seeds), {n: 1 for n, _ in seeds}, [n for n, _ in seeds], {}
    while todo:
        n = todo.pop(0)
        if depth[n] > 2:
            continue
        for s, r, o in edges:
            if n in (s, o):
                best[s, r, o] = max(best.get((s, r, o), 0.0), score[n])
        for other in [o for s, _, o in edges if s == n] + [s for s, _, o in edges if o == n]:
            if other not in score:
                score[other], depth[other] = score[n] * 0.5, depth[n] + 1
                todo.append(other)
    df = spark.createDataFrame(edges, "subject string, predicate string, object string")
    sd = spark.createDataFrame([(0, n, s) for n, s in seeds], "query_id int, name string, score double")
    got = {(r.src, r.relation, r.dst): r.score for r in retrieval.decayed_subgraph(df, sd, 2, 1000).collect()}
    assert got == pytest.approx(best)


def test_capacity_assignment_matches_loop(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(30, 3)).round(3), rng.normal(size=(3, 3)).round(3)
    d = np.round(np.sqrt(((x[:, None] - c) ** 2).sum(2)), 9)
    order, load, expect = np.argsort(d, axis=1, kind="stable"), [0] * 3, {}
    for r in range(3):
        for i in range(30):
            k = int(order[i, r])
            if i not in expect and load[k] < 8:
                expect[i] = k
                load[k] += 1
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "name int, embedding array<double>")
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster int, center array<double>")
    for cells in (0, 40, 10**6):  # rounds on the cluster alone, both, the driver alone
        got = {r.item: r.cluster for r in dedup.assign_with_capacity(items, centers, 8, last_cells=cells).collect()}
        assert got == {i: expect.get(i, 3) for i in range(30)}


def test_capacity_assignment_asks_for_more_centres(spark, monkeypatch):
    monkeypatch.setattr(dedup, "RANKS", 2)
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(60, 3)).round(3), rng.normal(size=(7, 3)).round(3)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "name int, embedding array<double>")
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster int, center array<double>")
    first, second = ({r.item: r.cluster for r in dedup.assign_with_capacity(items, centers, 8, last_cells=n).collect()} for n in (0, 10**6))
    assert first == second and len(first) == 60 and list(first.values()).count(7) == 4


def test_semantic_dedup_joins_forms(spark):
    g = Graph.from_rows(spark, ["Cities", "City", "Road"], [("Cities", "has", "Road"), ("City", "has", "Road")])
    out = dedup.semantic_dedup(g, dedup.hashing_embedder(), 0.95)
    assert pairs(out.triples, "subject", "object") == [("Cities", "Road")]


def test_judge_failure_keeps_items(spark):
    def broken(item, candidates):
        raise RuntimeError

    clusters = spark.createDataFrame([("a", 0), ("b", 0)], "item string, cluster int")
    options = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "item string, candidates array<string>")
    assert pairs(dedup.judged_clusters(clusters, options, broken), "representative", "member") == [("a", "a"), ("b", "b")]


def test_extraction_uses_the_cache(spark):
    chunks = spark.createDataFrame([("1", "Alpha meets Beta."), ("2", "Alpha meets Beta."), ("3", None)], "chunk_id string, text string")
    none = spark.createDataFrame([], "key string, value string")
    graph, fresh = extraction.extract(chunks, none)
    assert pairs(graph.triples, "subject", "object") == [("Alpha", "Beta")]
    _, more = extraction.extract(chunks, fresh)
    assert fresh.count() == 4 and more.count() == 0
