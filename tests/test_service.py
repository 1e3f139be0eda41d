import pytest
from pyspark.sql import functions as F

from graphloom.adapters import ModelSettings, model_name, normalize_messages
from graphloom.operators.dedup import hashing_embedder
from graphloom.plans.graph import Graph
from graphloom.service import DomainService
from graphloom.streaming.pages import stream_chunks, write_chunks


@pytest.fixture(scope="module")
def service(spark):
    embed = hashing_embedder()
    chunks = embed(spark.createDataFrame([("trucks move goods",), ("ships cross seas",)], "text string"))
    chunks = chunks.select(F.monotonically_increasing_id().alias("chunk_id"), F.col("text").alias("content"), F.lit("s").alias("source"), F.lit(1).alias("page"), "embedding")
    graph = Graph.from_rows(spark, ["truck", "ship", "sea"], [("ship", "crosses", "sea")])
    return DomainService(spark, chunks, graph, embed)


def test_routing(service):
    assert service.resolve_mode(" AUTO ") == "graphrag"
    with pytest.raises(ValueError):
        service.resolve_mode("other")


def test_hybrid_sources_and_events(service):
    sources = service.retrieve("ship on the sea", "hybrid")
    kinds = [s["type"] for s in sources]
    assert kinds == sorted(kinds, key=["chunk", "entity", "triple"].index) and set(kinds) == {"chunk", "entity", "triple"}
    events = [e["type"] for e in service.stream("ship", "graphrag")]
    assert events[:2] == ["status", "meta"] and events[-1] == "done"


def test_adapters():
    assert normalize_messages([{"role": "human", "content": ["a", {"type": "text", "text": "b"}]}]) == [{"role": "user", "content": "a\nb"}]
    assert model_name("x") == "openai/x" and model_name("a/b") == "a/b"
    with pytest.raises(ValueError):
        ModelSettings("gpt-5").checked()


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "doc_id long, text string"
    for i in range(2):
        spark.createDataFrame([(i, "One. Two!")], schema).write.mode("append").parquet(src)
        write_chunks(stream_chunks(spark, src, schema), out, ck).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [0, 1]
