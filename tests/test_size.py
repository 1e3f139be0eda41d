"""Steps whose memory, files or shuffle must not follow the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunking, dedup, extraction, retrieval
from graphloom.plans import analytics
from graphloom.plans.graph import Graph, collapse, sink_edges
from graphloom.sources import readers, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_structured_documents_share_files(spark, tmp_path):
    """Many documents, a few files; any name comes back as it was."""
    names = [*(f"d{i}" for i in range(40)), "a/b c=1", "x_graph_y", "é%20"]
    docs = spark.createDataFrame([(n, f"T {n}", [("h", 1, "line\n")]) for n in names], "doc_id string, title string, sections array<struct<heading:string,level:int,content:string>>")
    sinks.write_structured(docs.coalesce(2), f"{tmp_path}/out")
    assert len([p for p in (tmp_path / "out").rglob("part-*")]) <= 2
    got = readers.structured_documents(spark, f"{tmp_path}/out").collect()
    assert sorted(r.doc_id for r in got) == sorted(names) and all(r.title == f"T {r.doc_id}" and r.sections[0].content == "line\n" for r in got)


def test_kernels_take_a_few_rows_at_a_time(spark):
    rows = spark.range(0, 900, 1, 1).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("Alpha; "), F.col("id").cast("string")).alias("text"))

    def call(batches):
        for pdf in batches:
            assert len(pdf) <= chunking.SLICE_ROWS
            yield pdf.assign(value=pdf["text"])[["key", "value"]]

    answered, _ = extraction.through_cache(rows, "key", spark.createDataFrame([], "key string, value string"), call, ["text"])
    assert answered.filter("value = text").count() == 900
    cut = chunking.chunk_documents(rows, 5)
    assert "MapInArrow" in plan(cut)
    assert sorted(map(tuple, cut.filter("key = '899'").collect())) == [("899", 0, "Alpha"), ("899", 1, ";"), ("899", 2, "899")] or cut.filter("key = '899'").count() == len(chunking.pack_sentences("Alpha; 899", 5))


def test_edges_are_dealt_out_before_names_are_sorted(spark, tmp_path):
    spark.createDataFrame([("a", "p", "b"), ("a", "q", "b"), ("b", "p-", "c"), ("b", "p_", "c")], "subject string, predicate string, object string").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    for made in (collapse(t), sink_edges(Graph.of(t))):
        lines = plan(made).splitlines()
        last = max(i for i, x in enumerate(lines) if "SortAggregate" in x)
        assert any("Exchange" in x for x in lines[last:]) and not any("SortAggregate" in x for x in lines[next(i for i, x in enumerate(lines) if "Exchange" in x):])
    assert sorted((r.src, r.dst, r.relation, r.pos) for r in collapse(t).collect()) == [("a", "b", "q", "p"), ("b", "c", "p_", "p-")]


def test_pairs_are_found_without_a_shuffle(spark, monkeypatch):
    """Every pair once, whichever blocks and slices its ends are in, for numbers and for names."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(dedup, "CELLS", 60)
    x = np.random.default_rng(8).normal(size=(90, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for kind, name in (("long", int), ("string", "n{}".format)):
        items = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)], f"name {kind}, embedding array<double>")
        found = dedup.similar_pairs(items, 0.7)
        assert "Exchange" not in plan(found)
        expect = sorted(tuple(sorted((name(i), name(j)))) for i in range(90) for j in range(i) if unit[i] @ unit[j] >= 0.7)
        assert sorted((r.a, r.b) for r in found.collect()) == expect and expect


def test_links_shrink_to_stars_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(analytics, "STAR_LINKS", 50)
    monkeypatch.setattr(analytics, "STAR_NAMES", 30)
    rng = np.random.default_rng(9)
    pairs = [(f"g{c}n{a}", f"g{c}n{b}") for c in range(6) for a, b in rng.integers(0, 25, (200, 2)) if a != b]
    links = spark.createDataFrame(pairs, "u string, v string").repartition(2)
    assert "Exchange" not in plan(analytics._stars(links.limit(0).coalesce(1))).split("MapInArrow")[0]
    assert analytics._stars(links).count() < 2 * 12 * 150 // 3
    names = {n for p in pairs for n in p}
    got = analytics.components(Graph.from_rows(spark, sorted(names), [(u, "p", v) for u, v in pairs])).collect()
    low = {f"g{c}": min(n for n in names if n.startswith(f"g{c}n")) for c in range(6)}
    assert {r.name: r.component for r in got} == {n: low[n.split("n")[0]] for n in names}


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_settled_queries_take_no_further_step(spark, sign):
    """The best k as from a search of all levels; a query with k better edges is left out of the next step."""
    edges = [("h", "p", f"m{i:02d}") for i in range(12)] + [(f"m{i:02d}", "p", f"z{j}") for i in range(12) for j in range(3)] + [("s", "p", "m00"), ("t", "p", "z0")]
    t = spark.createDataFrame(edges, "subject string, predicate string, object string")
    seeds = spark.createDataFrame([(0, "h", sign), (1, "s", sign * 0.5), (2, "t", sign * 0.1), (2, "h", 0.9)], "query_id int, name string, score double")
    for k in (3, 8):
        every = [(r.query_id, r.src, r.dst, r.score) for r in retrieval.decayed_subgraph(t, seeds, 2, 10_000).orderBy("query_id", "rank").collect()]
        best = [x for q in range(3) for x in [y for y in every if y[0] == q][:k]]
        assert [(r.query_id, r.src, r.dst, r.score) for r in retrieval.decayed_subgraph(t, seeds, 2, k).orderBy("query_id", "rank").collect()] == best
        every = [tuple(r) for r in retrieval.subgraph_entities(t, seeds, 2, 10_000).orderBy("query_id", "rank").collect()]
        assert [tuple(r) for r in retrieval.subgraph_entities(t, seeds, 2, k).orderBy("query_id", "rank").collect()] == [x for q in range(3) for x in [y for y in every if y[0] == q][:k]]
    left = retrieval._unsettled(seeds.filter("query_id = 0"), t.select(F.lit(0).alias("query_id"), F.lit(0.9).alias("score")), 3)
    assert left.count() == 0
