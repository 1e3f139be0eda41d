"""Batch build: structured documents to a merged graph; python -m graphloom.main INPUT OUTPUT.

Documents go through a per-document store under OUTPUT: what is there is not extracted again, and one that fails is reported
and left for the next run.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build
from .operators import dedup, sections
from .plans.graph import Graph
from .sources import readers, sinks


def build_graph(docs: DataFrame, store: str, config: readers.Config = readers.Config(), embed=None, force: bool = False, method: str = "semantic", cleaned: str | None = None, **adapters) -> tuple[Graph, DataFrame]:
    """(graph, failed documents) of structured documents: clean, flatten, extract per document, merge, deduplicate.

    With *cleaned*, the cleaned documents are also written there as JSON.
    """
    body = sections.clean(readers.sections_of(docs))
    titles = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"))
    if cleaned:
        sinks.write_structured(sinks.as_documents(body, titles), cleaned)
    texts = sections.flatten(body, titles)
    graph, failed = build.build_documents(texts, store, config.chunk_size, force, model=config.model, **adapters)
    return dedup.deduplicate(graph, method, embed, config.threshold), failed


def main(argv: list[str] | None = None, send=None) -> int:
    """0, or 1 if a document failed.  *send* is the adapter of a graph database for --upload."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--config")
    p.add_argument("--force", action="store_true", help="extract every document again")
    p.add_argument("--method", choices=("semantic", "judged", "full"), default="semantic", help="deduplication")
    p.add_argument("--upload", action="store_true", help="send the graph to the property graph sink")
    p.add_argument("--clear", action="store_true", help="empty the property graph before")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    config = readers.load_config(a.config) if a.config else readers.Config()
    graph, failed = build_graph(readers.structured_documents(spark, a.input), f"{a.output}/store", config, force=a.force, method=a.method, cleaned=f"{a.output}/cleaned")
    sinks.write_graph(graph, f"{a.output}/graph")
    graph = sinks.read_graph(spark, f"{a.output}/graph")
    sinks.write_graph_json(graph, f"{a.output}/graph_json")
    sinks.write_property_tables(graph, f"{a.output}/property_graph")
    if a.upload:
        if send is None:
            raise ValueError("--upload needs an adapter of a graph database")
        sink = sinks.PropertyGraphSink(send)
        if a.clear:
            sink.clear()
        sink.try_upload(graph, "merged")
    lost = failed.orderBy("doc_id").limit(20).collect()  # a report
    for r in lost:
        print(f"failed: {r.doc_id}: {r.error}")
    return int(bool(lost))


if __name__ == "__main__":
    raise SystemExit(main())
