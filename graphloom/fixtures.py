"""Graphs and tables derived from the test data: KG from the star schema, SIM from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.retrieval import cosine
from .plans.analytics import _persisted
from .plans.graph import Graph

SIM_THRESHOLD = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_of and located_in triples of nations, suppliers and customers."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    triple = lambda s, p, o: [F.col(s).alias("subject"), F.lit(p).alias("predicate"), F.col(o).alias("object")]
    part = nation.join(region, nation.n_regionkey == region.r_regionkey).select(*triple("n_name", "part_of", "r_name"))
    named = nation.select("n_nationkey", "n_name")
    sup = table(spark, sf_dir, "supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey")).select(*triple("s_name", "located_in", "n_name"))
    cust = table(spark, sf_dir, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select(*triple("c_name", "located_in", "n_name"))
    return part.unionByName(sup).unionByName(cust).distinct()


def supply_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distinct keys first, so the join sees each pair once
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return items.join(sup, items.l_suppkey == sup.s_suppkey).select(
        F.col("s_name").alias("subject"), F.concat(F.lit("supplies_"), "l_returnflag").alias("predicate"), F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("object")
    )


def kg(spark: SparkSession, sf_dir: str) -> Graph:
    """The triples are written once; entities and predicates are read from there."""
    return Graph.of(_persisted(place_triples(spark, sf_dir).unionByName(supply_triples(spark, sf_dir))))


def places(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(place_triples(spark, sf_dir))


def sim_pairs(spark: SparkSession, sf_dir: str, threshold: float = SIM_THRESHOLD) -> DataFrame:
    from .operators.dedup import similar_pairs

    return similar_pairs(table(spark, sf_dir, "embeddings"), threshold, "vec_id", "embedding")


def sim(spark: SparkSession, sf_dir: str) -> Graph:
    """Vectors as entities v<id>, similar ones linked; the triples, different by their making, are written once."""
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    triples = sim_pairs(spark, sf_dir).select(name("a").alias("subject"), F.lit("similar").alias("predicate"), name("b").alias("object"))
    triples = _persisted(triples)
    return Graph(table(spark, sf_dir, "embeddings").select(name("vec_id").alias("name")).distinct(), triples.select("predicate").distinct(), triples)


__all__ = ["cosine", "kg", "place_triples", "places", "sim", "sim_pairs", "supply_triples", "table"]
