"""The graph bundle: six tables, and their set algebra as plans."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def _endpoints(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("subject", "object")).alias("name"))


@dataclass(frozen=True)
class Graph:
    """entities(name), predicates(predicate), triples(subject, predicate, object), optional clusters and metadata."""

    entities: DataFrame
    predicates: DataFrame
    triples: DataFrame
    entity_clusters: DataFrame | None = None
    edge_clusters: DataFrame | None = None
    metadata: DataFrame | None = None

    @classmethod
    def of(cls, triples: DataFrame, entities: DataFrame | None = None, **more) -> Graph:
        """A graph of *triples*; entities default to the endpoints and are always repaired to hold them."""
        triples = triples.select("subject", "predicate", "object").distinct()
        names = _endpoints(triples)
        if entities is not None:
            names = names.unionByName(entities.select("name"))
        return cls(names.distinct(), triples.select("predicate").distinct(), triples, **more)

    @classmethod
    def from_rows(cls, spark: SparkSession, entities: list[str], triples: list[tuple[str, str, str]], predicates: list[str] = ()) -> Graph:
        """A small graph as given, without repair."""
        t = spark.createDataFrame(triples, schema.TRIPLES).distinct()
        names = predicates or sorted({p for _, p, _ in triples})
        return cls(spark.createDataFrame([(e,) for e in entities], schema.ENTITIES).distinct(), spark.createDataFrame([(p,) for p in names], schema.PREDICATES).distinct(), t)

    def repair(self) -> Graph:
        """Missing endpoints become entities, missing predicates join the vocabulary."""
        entities = self.entities.select("name").unionByName(_endpoints(self.triples)).distinct()
        predicates = self.predicates.select("predicate").unionByName(self.triples.select("predicate")).distinct()
        return replace(self, entities=entities, predicates=predicates)

    def stats(self) -> DataFrame:
        """One row: n_entities, n_predicates, n_triples."""
        parts = [self.entities.select(F.lit("e").alias("k")), self.predicates.select(F.lit("p").alias("k")), self.triples.select(F.lit("t").alias("k"))]
        count = lambda k: F.count_if(F.col("k") == k)
        return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(count("e").alias("n_entities"), count("p").alias("n_predicates"), count("t").alias("n_triples"))


def merge(graphs: list[Graph]) -> Graph:
    """Exact union of entities, predicates, triples and metadata; clusters are not carried over."""
    if not graphs:
        raise ValueError("nothing to merge")

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out.distinct()

    metadata = [g.metadata for g in graphs if g.metadata is not None]
    return Graph(
        union([g.entities for g in graphs]),
        union([g.predicates for g in graphs]),
        union([g.triples for g in graphs]),
        metadata=union(metadata) if metadata else None,
    )


def collapse(triples: DataFrame, order: str | Column = "predicate") -> DataFrame:
    """One edge per (src, dst): the relation that comes last in *order*, and the position of the first.

    The rows of a pair are dealt out first: aggregates of names sort their rows, and a task would sort all rows of a file before.
    """
    at = F.col(order) if isinstance(order, str) else order
    dealt = triples.repartition("subject", "object")
    return dealt.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.max_by("predicate", at).alias("relation"), F.min(at).alias("pos"))


def sanitize_predicate(p: Column) -> Column:
    """A name that a property graph accepts: other characters become _, empty REL, leading digits get REL_."""
    clean = F.regexp_replace(p, "[^0-9A-Za-z_一-鿿]", "_")
    return F.when(clean == "", "REL").when(clean.rlike("^[0-9]"), F.concat(F.lit("REL_"), clean)).otherwise(clean)


def sink_edges(graph: Graph) -> DataFrame:
    """Edges as a property graph stores them: both ends exist, one edge per (subject, clean predicate, object)."""
    ends = graph.entities.select("name")
    linked = graph.triples.join(ends.select(F.col("name").alias("subject")), "subject", "left_semi").join(ends.select(F.col("name").alias("object")), "object", "left_semi")
    # dealt out before names are sorted, by both ends: an object may have most of the edges
    return linked.repartition("subject", "object").groupBy("subject", sanitize_predicate(F.col("predicate")).alias("rel_type"), "object").agg(F.max("predicate").alias("predicate"))


def rewrite(graph: Graph, entity_map: DataFrame, edge_map: DataFrame) -> Graph:
    """Every name replaced by its canonical one; maps are (name, canonical) with one row per name; misses stay.

    Clusters and metadata follow: representatives and members are rewritten, sets that meet are united.
    """

    def canon(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
        m = mapping.select(F.col("name").alias(column), F.col("canonical").alias("_to"))
        return df.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    def clusters(df: DataFrame | None, mapping: DataFrame) -> DataFrame | None:
        return None if df is None else canon(canon(df, "representative", mapping), "member", mapping).select("representative", "member").distinct()

    triples = canon(canon(canon(graph.triples, "subject", entity_map), "object", entity_map), "predicate", edge_map)
    return Graph(
        canon(graph.entities, "name", entity_map).distinct(),
        canon(graph.predicates, "predicate", edge_map).distinct(),
        triples.select("subject", "predicate", "object").distinct(),
        clusters(graph.entity_clusters, entity_map),
        clusters(graph.edge_clusters, edge_map),
        None if graph.metadata is None else canon(graph.metadata, "entity", entity_map).select("entity", "value").distinct(),
    )


def rewrite_by_clusters(graph: Graph) -> Graph:
    """Names outside the kept sets become the first representative (by name) whose cluster holds them."""

    def mapping(kept: DataFrame, column: str, clusters: DataFrame | None) -> DataFrame:
        if clusters is None:
            return kept.sparkSession.createDataFrame([], "name string, canonical string")
        first = clusters.groupBy(F.col("member").alias("name")).agg(F.min("representative").alias("canonical"))
        return first.join(kept.select(F.col(column).alias("name")), "name", "left_anti")

    out = rewrite(replace(graph, entity_clusters=None, edge_clusters=None), mapping(graph.entities, "name", graph.entity_clusters), mapping(graph.predicates, "predicate", graph.edge_clusters))
    return replace(out, entities=graph.entities, predicates=graph.predicates, entity_clusters=graph.entity_clusters, edge_clusters=graph.edge_clusters)
