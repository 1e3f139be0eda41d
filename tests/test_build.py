import json

import pytest
from pyspark.sql import functions as F

from graphloom import adapters, build, main
from graphloom.component_queries import _line_pages
from graphloom.operators import dedup, extraction, retrieval, sections
from graphloom.plans import analytics
from graphloom.plans.graph import Graph, rewrite, rewrite_by_clusters
from graphloom.sources import readers, sinks

EMBED = lambda df: dedup.hashing_embedder()(df)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_page_job_resumes_by_document(spark, tmp_path):
    """Two documents share page numbers; pages in the checkpoint are not asked again, later lines win."""
    page = lambda i, t: json.dumps({"id": i, "text": t})
    pages = spark.createDataFrame([("a", 1, page("a", "H\nx")), ("a", 2, page("a", "more")), ("b", 1, page("b", "K\ny"))], "source string, page int, content string")
    check, out = f"{tmp_path}/pages", f"{tmp_path}/out"
    old = spark.createDataFrame([("a", 1, page("a", "old\nold"))], pages.schema)
    sinks.append_pages(build.parse_pages(old, _line_pages), check)
    sinks.append_pages(build.parse_pages(pages.filter("source = 'a' and page = 1"), _line_pages), check)
    asked = f"{tmp_path}/asked"

    def model(content):
        with open(asked, "a") as f:
            f.write(content + "\n")
        return _line_pages(content)

    docs = {r.doc_id: r for r in build.ingest_pages(pages, model, check, out).collect()}
    assert [(s.heading, s.content) for s in docs["a"].sections] == [("H", "x\n")] and [(s.heading, s.content) for s in docs["b"].sections] == [("K", "y\n")]
    assert docs["a"].title == "Title a"
    assert sorted(json.loads(x)["text"] for x in open(asked)) == ["K\ny", "more"]
    assert not (tmp_path / "pages").exists()
    again = build.ingest_pages(pages, _line_pages, check, out, force=True)
    assert rows(again.select("doc_id")) == [("a",), ("b",)]


def test_cleaned_documents_are_written_elsewhere(spark, tmp_path):
    row = [("d", "T", [("前言", 1, "no"), ("1.1 物流", 1, "yes")])]
    docs = spark.createDataFrame(row, "doc_id string, title string, sections array<struct<heading:string,level:int,content:string>>")
    (got,) = build.clean_documents(docs, f"{tmp_path}/clean").collect()
    assert [s.heading for s in got.sections] == ["1.1 物流"] and got.doc_id == "d"


def test_structured_documents_by_file_name(spark, tmp_path):
    for name in ("one", "two", "two_graph"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"title": name, "sections": [{"heading": "h", "level": 1, "content": "c"}]}))
    assert rows(readers.structured_documents(spark, str(tmp_path)).select("doc_id", "title")) == [("one", "one"), ("two", "two")]


def test_texts_config_and_prompt(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert rows(readers.texts(spark, str(tmp_path / "a.txt"))) == [("a.txt", "one\ntwo")]
    (tmp_path / "c.json").write_text(json.dumps({"top_k": 9, "other": 1}))
    config = readers.load_config(str(tmp_path / "c.json"))
    assert config.top_k == 9 and config.more == {"other": 1} and config.chunk_size == 16384
    with pytest.raises(FileNotFoundError):
        readers.load_config(str(tmp_path / "none.json"))
    assert readers.prompt(str(tmp_path / "a.txt")) == "one\ntwo"
    assert readers.messages([{"role": "user", "content": "a"}, {"role": "system", "content": "b"}]) == [{"role": "user", "content": "a"}]
    with pytest.raises(ValueError):
        readers.messages([{"role": "user"}])


def test_pdf_scan_skips_broken_files_and_blank_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"one|two| ")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parser(content):
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().split("|")

    got = readers.pdf_pages(spark, str(tmp_path), parser).collect()
    assert sorted((r.source, r.page or 0, r.text or "", r.error or "") for r in got) == [("a.pdf", 1, "one", ""), ("a.pdf", 2, "two", ""), ("b.pdf", 0, "", "no pages")]


def test_context_length_falls_back_to_chunks(spark):
    long = "Alpha meets Beta. " * 2000
    texts = spark.createDataFrame([("a", long), ("b", "Gamma meets Delta."), ("c", "boom Epsilon meets Zeta."), ("d", None)], "doc_id string, text string")

    def model(text):
        if len(text) > 20_000:
            raise ValueError("maximum context length exceeded")
        if text.startswith("boom"):
            raise ValueError("no answer")
        return extraction.rule_entities(text)

    cache = spark.createDataFrame([], "key string, value string")
    names, triples, failed, fresh = build.extract_texts(texts, cache, entities=model)
    assert rows(failed) == [("c", "no answer")]
    assert {(r.doc_id, r.subject, r.object) for r in triples.collect()} >= {("a", "Alpha", "Beta"), ("b", "Gamma", "Delta")}
    assert not [r for r in names.collect() if r.doc_id == "c"] and not fresh.filter(F.col("value").startswith(extraction.FAILED)).count()


def test_per_document_store_and_main(spark, tmp_path):
    calls = tmp_path / "calls"

    def model(text):
        with open(calls, "a") as f:
            f.write("x")
        return extraction.rule_entities(text)

    texts = spark.createDataFrame([("a", "Alpha meets Beta."), ("b", "Gamma meets Delta.")], "doc_id string, text string")
    store = f"{tmp_path}/store"
    build.build_documents(texts.limit(1), store, entities=model)
    graph, failed = build.build_documents(texts, store, entities=model)
    assert calls.read_text() == "xx" and failed.count() == 0
    assert rows(graph.triples) == [("Alpha", "near", "Beta"), ("Gamma", "near", "Delta")]
    build.build_documents(texts, store, force=True, entities=model)
    assert calls.read_text() == "xxxx"

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "d.json").write_text(json.dumps({"title": "D", "sections": [{"heading": "1.1 Alpha", "level": 1, "content": "Alpha meets Beta and Betas."}]}))
    sent = tmp_path / "sent"

    def send(kind, batch):
        with open(sent, "a") as f:
            f.write(f"{kind}:{len(batch)} ")

    out = str(tmp_path / "out")
    assert main.main([str(folder), out, "--upload", "--clear"], send) == 0
    saved = sinks.read_graph(spark, f"{out}/graph")
    assert {("Alpha", "near", "Beta")} <= {tuple(r) for r in saved.triples.collect()}
    assert sent.read_text().startswith("clear:0") and "node:" in sent.read_text() and "edge:" in sent.read_text()
    assert readers.structured_documents(spark, f"{out}/cleaned").first().doc_id == "d"


def test_conversations_and_methods(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Alpha Beta"), (1, 1, "system", "Gamma Delta"), (1, 2, "assistant", "Alphas Beta")], "conv_id long, turn long, role string, text string")
    plain = build.generate_from_conversations(turns, method=None)
    assert {r.name for r in plain.entities.collect()} == {"Alpha", "Alphas", "Beta"}
    for method in ("semantic", "judged", "full"):
        graph = build.generate_from_conversations(turns, method=method)
        assert {r.name for r in graph.entities.collect()} == {"Alpha", "Beta"}, method
        assert rows(graph.triples) == [("Alpha", "near", "Beta")]
    with pytest.raises(ValueError):
        dedup.deduplicate(plain, "other")


def test_judged_predicates_and_metadata(spark):
    g = Graph.from_rows(spark, ["a", "b"], [("a", "Owns", "b"), ("a", "own", "b")])
    g = Graph(g.entities, g.predicates, g.triples, metadata=spark.createDataFrame([("a", "x")], "entity string, value string"))
    out = build.judged_dedup(g, EMBED)
    assert rows(out.triples) == [("a", "own", "b")] and rows(out.metadata) == [("a", "x")]
    assert {("own", "Owns")} <= {tuple(r) for r in out.edge_clusters.collect()}
    empty = build.judged_map(spark.createDataFrame([], "name string"), EMBED)
    assert empty.count() == 0


def test_rewrite_of_clusters_and_members(spark):
    clusters = spark.createDataFrame([("B", "x"), ("A", "x"), ("A", "kept")], "representative string, member string")
    t = spark.createDataFrame([("x", "p", "kept"), ("other", "p", "x")], "subject string, predicate string, object string")
    g = Graph(spark.createDataFrame([("A",), ("B",), ("kept",)], "name string"), spark.createDataFrame([("p",)], "predicate string"), t, clusters)
    assert rows(rewrite_by_clusters(g).triples) == [("A", "p", "kept"), ("other", "p", "A")]
    to = spark.createDataFrame([("x", "X"), ("B", "A")], "name string, canonical string")
    assert rows(rewrite(g, to, spark.createDataFrame([], "name string, canonical string")).entity_clusters) == [("A", "X"), ("A", "kept")]


def test_colors_match_the_standard_library(spark):
    labels = [f"predicate::p{i}" for i in range(300)]
    got = spark.createDataFrame([(x,) for x in labels], "label string").select("label", analytics.label_color(F.col("label")).alias("c")).collect()
    assert all(r.c == analytics.color_of(r.label) for r in got)


def test_nearest_matches_numpy_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[7] = x[8] = x[9]  # ties go by item
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(3)
    queries = items.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 6)
    expect = [(q, int(i), r + 1) for q in range(0, 60, 7) for r, i in enumerate(sorted(range(60), key=lambda i: (-cos[q, i], i))[:4])]
    got = sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.nearest(items, queries, 4).collect())
    assert got == sorted(expect)
    assert retrieval.nearest(items, queries.limit(0), 4).count() == 0 and retrieval.nearest(items.limit(0), queries, 4).count() == 0


def test_index_needs_documents_and_settings(spark, tmp_path):
    path = str(tmp_path / "index")
    pages = spark.createDataFrame([("a", 1, "Trucks move goods. Ships cross seas.")], "source string, page int, text string")
    with pytest.raises(ValueError):
        build.build_index(pages.limit(0), path, EMBED, {"m": "1"})
    chunks, lexical, built = build.build_index(pages, path, EMBED, {"m": "1"})
    assert built and not build.build_index(pages, path, EMBED, {"m": "1"})[2]
    queries = EMBED(spark.createDataFrame([("ships cross", 0)], "text string, query_id int")).withColumnRenamed("embedding", "query_vector")
    assert [r.doc_id for r in build.search_index(chunks, lexical, queries).collect()] == ["a#1#0"]


def test_dashboard_and_title(spark, tmp_path):
    g = Graph.from_rows(spark, ["a", "b", "<c>"], [("a", "p", "b")])
    sinks.write_dashboard(g, f"{tmp_path}/page")
    text = "".join(p.read_text() for p in (tmp_path / "page").glob("part-*"))
    assert text.startswith("<!doctype html>") and "&lt;c&gt;" in text
    with pytest.raises(ValueError):
        sinks.write_dashboard(Graph.from_rows(spark, [], []), f"{tmp_path}/none")
    pages = spark.createDataFrame([("d", 2, "Two"), ("d", 1, ""), ("d", 3, "Three"), ("e", 1, None)], "doc_id string, page int, title string")
    assert rows(sections.pick_title(pages)) == [("d", "Two"), ("e", "")]
    failing = sinks.PropertyGraphSink(lambda kind, batch: 1 / 0)
    assert failing.try_upload(g) is False
    assert sinks.PropertyGraphSink(lambda kind, batch: None).upload(g) == (3, 1)


def test_chat_adapter_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers.get("Authorization"), body))
            if len(asked) == 1:
                self.send_error(500)
                return
            self.send_response(200)
            self.end_headers()
            if body.get("stream"):
                for t in ("he", "llo"):
                    self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': t}}]})}\n\n".encode())
                self.wfile.write(b"data: [DONE]\n\n")
            else:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": "hello"}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = adapters.HttpChatModel(f"http://127.0.0.1:{server.server_port}/v1", "key", adapters.ModelSettings("m", retries=2), pause=0)
        assert model.chat([{"role": "human", "content": "hi"}]) == "hello"  # after one failure
        assert list(model.stream("hi")) == ["he", "llo"]
        assert asked[-1][0] == "Bearer key" and asked[-1][1]["messages"] == [{"role": "user", "content": "hi"}]
    finally:
        server.shutdown()


def test_page_images_and_extractors_over_chat(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    images = readers.pdf_page_images(spark, str(tmp_path), lambda content, dpi: [x + str(dpi).encode() for x in content.split(b"|")], 90)
    import base64

    assert sorted((r.page, base64.b64decode(r.content)) for r in images.collect()) == [(1, b"one90"), (2, b"two90")]

    class Model:
        def see(self, messages):
            return json.dumps([p["type"] for p in messages[0]["content"]])

        def chat(self, messages):
            return messages[0]["content"][:45] + "|" + messages[-1]["content"]

    assert adapters.PageReader(Model)("QQ==") == '["image_url", "text"]'
    ask = adapters.ChatExtractor(Model)
    assert ask.entities("text").endswith("|text") and '["a"]' in ask.relations("text", ["a"])
    assert adapters.ChatExtractor(Model, conversation=True).entities("x") != ask.entities("x")
    monkeypatch.setenv("GRAPHLOOM_GRAPH_HOST", "db")
    at = adapters.ConnectionSettings.from_environment()
    assert at.uri == "bolt://db:7687" and "password" not in repr(at)
    assert adapters.EmbedderSettings().environment()["HF_HUB_OFFLINE"] == "1"


def test_batch_embedder_and_cluster(spark):
    def load():
        return lambda texts: [[len(t), 1.0, float(len(texts))] for t in texts]

    df = spark.createDataFrame([(f"n{i}" * (i + 1),) for i in range(5)], "name string").coalesce(1)
    got = dedup.batch_embedder(load, batch=2)(df).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in got) and len(got) == 5
    g = Graph.from_rows(spark, ["Cats", "cat"], [("Cats", "p", "cat")])
    assert rows(dedup.cluster(g, method="semantic", embed=EMBED).entities) == [("Cats",)] or rows(dedup.cluster(g, method="semantic", embed=EMBED).entities) == [("cat",)]


def test_hashed_pairs_recall(spark):
    """Against all pairs: vectors in tight groups, at similarities around the threshold."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 32))
    x = np.concatenate([c + rng.normal(scale=0.22, size=(6, 32)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "name long, embedding array<double>")
    expect = {(r.a, r.b) for r in dedup.similar_pairs(items, 0.95).collect()}
    got = {(r.a, r.b) for r in dedup.hashed_similar_pairs(items, 0.95).collect()}
    assert got <= expect and len(expect) > 500 and len(got) >= 0.999 * len(expect)
    assert dedup.hashed_similar_pairs(items.limit(0), 0.95).count() == 0
