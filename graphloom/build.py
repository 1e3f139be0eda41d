"""Whole jobs over the operators: pages to documents, texts and conversations to graphs, judged deduplication, indexes.

Every step is a table in a shared folder, so a job that was stopped goes on from what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, dedup, extraction, retrieval, sections
from .plans.analytics import _persisted
from .plans.graph import Graph, collapse, rewrite_by_clusters
from .sources import readers, sinks

#: Page content -> answer of a page model (JSON, fenced or not).
PageModel = Callable[[str], str]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of *path*, empty if nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- pages ---


def parse_pages(pages: DataFrame, model: PageModel) -> DataFrame:
    """(source, skip, type, title, page, blocks) of pages (source, page, content); the page number is the input's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["source"], "page": pdf["page"], "answer": [model(c) for c in pdf["content"]]})

    answered = pages.select("source", F.col("page").cast("int").alias("page"), "content").mapInPandas(run, "source string, page int, answer string")
    record = answered.select("source", F.col("page").alias("no"), T.parse_page(F.col("answer")).alias("r"))
    return record.select("source", F.coalesce("r.skip", F.lit(False)).alias("skip"), "r.type", F.coalesce("r.title", F.lit("")).alias("title"), F.col("no").alias("page"), "r.blocks")


def ingest_pages(pages: DataFrame, model: PageModel, checkpoint: str, output: str, force: bool = False) -> DataFrame:
    """Structured documents of *pages*, written under *output*; pages already in *checkpoint* are not asked again.

    The checkpoint is kept by (source, page) and removed once the documents are written.
    """
    spark = pages.sparkSession
    if force:
        sinks.remove(spark, checkpoint)
    try:
        done = readers.page_checkpoint(spark, checkpoint).select("source", "page")
        todo = pages.join(done, ["source", "page"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = pages
    sinks.append_pages(parse_pages(todo, model), checkpoint)
    records = readers.page_checkpoint(spark, checkpoint).withColumnRenamed("source", "doc_id")
    kept = records.filter(~F.coalesce("skip", F.lit(False)))
    docs = sinks.as_documents(sections.assemble(kept.select("doc_id", "page", "blocks")), sections.pick_title(records))
    sinks.write_structured(docs, output)
    sinks.remove(spark, checkpoint)
    return readers.structured_documents(spark, output)


def clean_documents(docs: DataFrame, output: str) -> DataFrame:
    """Structured documents without unwanted sections, written as JSON to a new path."""
    body = sections.clean(readers.sections_of(docs))
    sinks.write_structured(sinks.as_documents(body, docs.select("doc_id", "title")), output)
    return readers.structured_documents(docs.sparkSession, output)


# --- graphs ---

CONTEXT_LENGTH = "context length"
FALLBACK_SIZE = 16384


def extract_texts(texts: DataFrame, cache: DataFrame, chunk_size: int | None = None, model: str = "rules", entities=extraction.rule_entities, relations=extraction.rule_relations, cap: int | None = extraction.ENTITY_CAP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(names(doc_id, name), triples(doc_id, ...), failed(doc_id, error), new cache rows) of texts (doc_id, text).

    Without *chunk_size* each text is one chunk; those whose model complains about its context length are asked again in
    chunks.  A document with any other failing chunk is in *failed* and leaves nothing else; the others are not touched.
    *cap*: names kept of a chunk, None for all.
    """

    def once(rows: DataFrame, size: int | None):
        if size:
            rows = chunking.chunk_documents(rows.select("doc_id", "text"), size).select("doc_id", F.col("chunk_no"), "text")
        else:
            rows = rows.select("doc_id", F.lit(0).alias("chunk_no"), "text").filter(T.strip(F.coalesce("text", F.lit(""))) != "")
        rows = rows.withColumn("chunk_id", F.to_json(F.struct("doc_id", "chunk_no")))
        found = extraction.extract_chunks(rows.select("chunk_id", "text"), cache, model, entities, relations, cap)
        names = rows.select("chunk_id", "doc_id")
        return [*(t.join(names, "chunk_id").drop("chunk_id") for t in found[:3]), found[3]]

    names, triples, failed, fresh = once(texts, chunk_size)
    failed = _persisted(failed.select("doc_id", "error"))
    if chunk_size is None:
        long = failed.filter(F.lower("error").contains(CONTEXT_LENGTH)).select("doc_id").distinct()
        more = once(texts.join(long, "doc_id", "left_semi"), FALLBACK_SIZE)
        failed = _persisted(failed.join(long, "doc_id", "left_anti").unionByName(more[2].select("doc_id", "error")))
        names, triples, fresh = names.unionByName(more[0]), triples.unionByName(more[1]), fresh.unionByName(more[3])
    bad = failed.select("doc_id").distinct()
    good = lambda t: t.join(bad, "doc_id", "left_anti").distinct()
    return good(names.select("doc_id", "name")), good(triples.select("doc_id", "subject", "predicate", "object")), failed.groupBy("doc_id").agg(F.min("error").alias("error")), fresh


def generate(texts: DataFrame, cache: DataFrame | None = None, chunk_size: int | None = None, method: str | None = "semantic", embed=None, threshold: float = 0.95, **adapters) -> Graph:
    """Graph of texts (doc_id, text): extraction, union over the documents, deduplication (None: without)."""
    spark = texts.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], "key string, value string")
    names, triples, _, _ = extract_texts(texts, cache, chunk_size, **adapters)
    graph = Graph.of(_persisted(triples.select("subject", "predicate", "object").distinct()), names.select("name"))
    return dedup.deduplicate(graph, method, embed or dedup.hashing_embedder(), threshold) if method else graph


def generate_from_conversations(turns: DataFrame, **options) -> Graph:
    """Graph of conversations (conv_id, turn, role, text): user and assistant turns, one text each."""
    return generate(extraction.flatten_conversations(turns).withColumnRenamed("conv_id", "doc_id"), **options)


NAMES, TRIPLES, FAILED = "doc_id string, name string", "doc_id string, subject string, predicate string, object string", "doc_id string, error string"


def build_documents(texts: DataFrame, store: str, chunk_size: int | None = FALLBACK_SIZE, force: bool = False, **adapters) -> tuple[Graph, DataFrame]:
    """(merged graph, failed documents) of texts (doc_id string, text) through the per-document store.

    A document in the store is not extracted again unless *force*; one that fails is reported and asked again next time.
    """
    spark = texts.sparkSession
    if force:
        sinks.remove(spark, store)
    done = _stored(spark, f"{store}/done", "doc_id string")
    todo = _persisted(texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(done, "doc_id", "left_anti"))
    cache = _stored(spark, f"{store}/cache", "key string, value string")
    names, triples, failed, fresh = extract_texts(todo, cache, chunk_size, **adapters)
    failed = _persisted(failed)
    names.write.mode("append").parquet(f"{store}/names")
    triples.write.mode("append").parquet(f"{store}/triples")
    fresh.write.mode("append").parquet(f"{store}/cache")
    # written last: a run that stops before this extracts its documents again, and repeated rows are united below
    todo.select("doc_id").distinct().join(failed, "doc_id", "left_anti").write.mode("append").parquet(f"{store}/done")
    every = _stored(spark, f"{store}/triples", TRIPLES)
    return Graph.of(every.select("subject", "predicate", "object"), _stored(spark, f"{store}/names", NAMES).select("name")), failed


# --- judged deduplication ---

CLUSTER_SIZE, CANDIDATES = 128, 16


def judged_map(names: DataFrame, embed, judge: dedup.Judge = dedup.plain_judge, seed: int = 42, capacity: int = CLUSTER_SIZE, candidates: int = CANDIDATES) -> DataFrame:
    """(representative, member) of a table with column name: k-means, balanced clusters, candidates, judge.

    Duplicates outside an item's cluster would be ignored, so its candidates are the best of its own cluster by half raw BM25
    and half cosine: at most *capacity* pairs an item.
    """
    items = _persisted(embed(names.select("name").distinct()))
    n = items.count()
    if not n:
        return names.sparkSession.createDataFrame([], "representative string, member string")
    centers = dedup.kmeans_centers(items, max(1, n // capacity), seed)
    clusters = _persisted(dedup.assign_with_capacity(items, centers, capacity))
    placed = _persisted(items.join(clusters, items.name == clusters.item).select("name", "embedding", "cluster"))
    own = placed.select("cluster", F.col("name").alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = placed.withColumnRenamed("name", "doc_id").join(own, "cluster").withColumn("cosine", retrieval.cosine(F.col("embedding"), F.col("query_vector")))
    index = retrieval.LexicalIndex.build(items.select(F.col("name").alias("doc_id")), T.tokens(F.col("doc_id")))
    where = placed.select("name", "cluster")
    asked = placed.select(F.col("name").alias("query_id"), "cluster", F.explode(T.tokens(F.col("name"))).alias("term")).groupBy("query_id", "cluster", "term").agg(F.count(F.lit(1)).alias("times"))
    posts = index.postings.join(where, index.postings.doc == where.name).select("doc", "cluster", "term", "tf", "length")
    # both sides carry the cluster, so a frequent term meets at most *capacity* items for each
    met = posts.join(asked, ["cluster", "term"]).join(index.weights, "term")
    gain = F.col("times") * F.col("idf") * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("length") / F.col("avgdl")))
    lexical = met.groupBy("query_id", F.col("doc").alias("doc_id")).agg(F.sum(gain).alias("bm25"))
    scored = retrieval.fuse_raw(pairs.select("query_id", "doc_id", "cosine"), lexical).withColumn("score", F.round("score", 9))
    best = retrieval.top_k(scored, candidates).groupBy(F.col("query_id").alias("item")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    return dedup.judged_clusters(clusters, best.select("item", F.transform("r", lambda x: x["doc_id"]).alias("candidates")), judge)


def judged_dedup(graph: Graph, embed, judge: dedup.Judge = dedup.plain_judge, capacity: int = CLUSTER_SIZE) -> Graph:
    """Entities and predicates judged separately, then the graph rewritten by the clusters; representatives are the new names."""
    entities = _persisted(judged_map(graph.entities, embed, judge, capacity=capacity))
    edges = _persisted(judged_map(graph.predicates.select(F.col("predicate").alias("name")), embed, judge, capacity=capacity))
    kept = lambda clusters, column: clusters.select(F.col("representative").alias(column)).distinct()
    return rewrite_by_clusters(Graph(kept(entities, "name"), kept(edges, "predicate"), graph.triples, entities, edges, graph.metadata))


# --- embeddings, context, index ---


def graph_embeddings(graph: Graph, embed) -> tuple[DataFrame, DataFrame]:
    """(nodes(name, embedding), relations(relation, embedding)); relations are those left after one edge per pair of nodes."""
    relations = collapse(graph.triples).select("relation").distinct()
    return embed(graph.entities.select("name")), embed(relations)


def graph_context(triples: DataFrame, nodes: DataFrame, queries: DataFrame, k: int = 8, depth: int = 2) -> DataFrame:
    """(query_id, context): sentences of the edges that walks of *depth* steps from the k nearest nodes use, sorted, joined by blanks.

    *nodes* (name, embedding), *queries* (query_id, query_vector).
    """
    seeds = retrieval.nearest(nodes, queries, k, item="name").select("query_id", "name")
    lines = retrieval.khop_context(triples, seeds, depth).select("query_id", T.triple_text(F.col("src"), F.col("relation"), F.col("dst")).alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("line")), " ").alias("context"))


#: How an index is laid out; one of another layout is built again.
LAYOUT = "counts"


def build_index(pages: DataFrame, path: str, embed, meta: dict[str, str], config: readers.Config = readers.Config()) -> tuple[DataFrame, retrieval.LexicalIndex, bool]:
    """(chunks, lexical index, built) of pages (source, page, text): read from *path* if it was made with the same *meta*, else built.

    chunks(doc_id, source, page, chunk, content, embedding).  An empty corpus is an error.
    """
    spark = pages.sparkSession
    meta = {**meta, "layout": LAYOUT}
    if (saved := readers.index(spark, path, meta)) is not None:
        return saved, retrieval.LexicalIndex.load(spark, path), False
    if pages.isEmpty():
        raise ValueError("there are no documents to index")
    cut = chunking.chunk_pages(pages.select("source", "page", "text"), config.passage_size, config.passage_overlap)
    named = cut.withColumn("doc_id", F.concat_ws("#", "source", F.col("page").cast("string"), F.col("chunk").cast("string")))
    chunks = embed(named.select("content", "doc_id", "source", "page", "chunk"))
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    lexical = retrieval.LexicalIndex.build(chunks, T.plain(F.col("content")), path=path)
    sinks.write_meta(spark, path, meta)
    return chunks, lexical, True


def search_index(chunks: DataFrame, lexical: retrieval.LexicalIndex, queries: DataFrame, k: int = 4, weight: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, text, query_vector) over a built index."""
    return retrieval.hybrid_top_k(chunks, queries, lexical.scores(queries, T.bigrams(F.col("text"))), k, weight)
