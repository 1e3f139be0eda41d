"""Graph analytics: degrees, rankings, isolation, components, statistics and the view model."""

from __future__ import annotations

import colorsys
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph


def degrees(graph: Graph) -> DataFrame:
    """name, degree, in_degree, out_degree of every entity; a loop counts twice in degree."""
    ends = graph.triples.select(F.inline(F.array(F.struct(F.col("subject").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    sums = ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return graph.entities.select("name").join(sums, "name", "left").select("name", *map(zero, ("degree", "in_degree", "out_degree")))


def predicate_counts(graph: Graph) -> DataFrame:
    return graph.triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def top_entities(graph: Graph, k: int = 10) -> DataFrame:
    return degrees(graph).orderBy(F.desc("degree"), F.lower("name"), "name").limit(k)


def top_predicates(graph: Graph, k: int = 10) -> DataFrame:
    return predicate_counts(graph).orderBy(F.desc("n"), F.lower("predicate"), "predicate").limit(k)


def isolated(graph: Graph) -> DataFrame:
    ends = graph.triples.select(F.explode(F.array("subject", "object")).alias("name"))
    return graph.entities.select("name").join(ends, "name", "left_anti")


def neighbors(graph: Graph) -> DataFrame:
    """name, neighbors: sorted distinct neighbours in either direction."""
    both = graph.triples.select(F.inline(F.array(F.struct(F.col("subject").alias("name"), F.col("object").alias("other")), F.struct(F.col("object").alias("name"), F.col("subject").alias("other")))))
    return both.groupBy("name").agg(F.array_sort(F.collect_set("other")).alias("neighbors"))


def statistics(graph: Graph) -> DataFrame:
    """One row: entities, triples, predicates, average degree (2 digits), density (3 digits)."""
    s = graph.stats()
    n, m = F.col("n_entities"), F.col("n_triples")
    return s.select(
        "n_entities",
        "n_predicates",
        "n_triples",
        F.when(n > 0, F.round(2.0 * m / n, 2)).otherwise(0.0).alias("average_degree"),
        F.when(n > 1, F.round(m / (n.cast("double") * (n - 1)), 3)).otherwise(0.0).alias("density"),
    )


def ordered_relations(graph: Graph) -> DataFrame:
    """Relations with ids e0, e1, ... in case-insensitive (predicate, subject, object) order.

    Positions come from a range sort and per-partition offsets, so no single task orders all relations.
    """
    keys = [F.lower("predicate"), F.lower("subject"), F.lower("object"), "predicate", "subject", "object"]
    ordered = graph.triples.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ordered = _persisted(ordered)
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low"))
    base = sizes.select("_p", "_low", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row per partition
    return ordered.join(F.broadcast(base), "_p").select(F.concat(F.lit("e"), (F.col("_base") + F.col("_i") - F.col("_low")).cast("string")).alias("id"), "subject", "predicate", "object")


def _shared_path(df: DataFrame) -> str:
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file:///tmp/graphloom-checkpoints"
    return f"{at.rstrip('/')}/graphloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _persisted(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = _shared_path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Links that a task of :func:`_stars` takes at a time, and names it may hold.
STAR_LINKS, STAR_NAMES = 1 << 18, 1 << 21


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest number of each number's component, of links between the numbers below *n*."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]
    return root


def _stars(links: DataFrame) -> DataFrame:
    """Links (u, v) with the same components as *links*, v the smallest name: what a task holds shrinks to a link per name."""

    def star(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
        coded = pa.concat_arrays([u, v]).dictionary_encode()
        names, codes = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        order = pc.sort_indices(names).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        codes = place[codes]
        root = _roots(codes[: len(u)], codes[len(u) :], len(order))
        at = np.flatnonzero(root != np.arange(len(order)))
        return names.take(pa.array(order[at])), names.take(pa.array(order[root[at]]))

    def run(batches):
        waiting, rows = [], 0
        held = None

        def shrink():
            us, vs = ([x[n] for x in ([held] if held else []) + waiting] for n in (0, 1))
            return star(pa.concat_arrays(us), pa.concat_arrays(vs))

        for batch in batches:
            waiting.append((batch.column(0), batch.column(1)))
            rows += batch.num_rows
            if rows >= STAR_LINKS:
                held, waiting, rows = shrink(), [], 0
                if len(held[0]) > STAR_NAMES:
                    yield pa.RecordBatch.from_arrays(list(held), names=["u", "v"])
                    held = None
        if waiting:
            held = shrink()
        if held is not None:
            yield pa.RecordBatch.from_arrays(list(held), names=["u", "v"])

    return links.mapInArrow(run, "u string, v string")


def components(graph: Graph) -> DataFrame:
    """name, component, size: the smallest name of each undirected component.

    Each task first shrinks its own links, then eight tasks' rests together, so that what is shuffled follows the names and not the
    links.  Then alternating star contraction: the number of rounds grows with the logarithm of the longest path.
    """
    up = graph.triples.filter("subject <> object").select(F.col("subject").alias("u"), F.col("object").alias("v"))
    first = _persisted(_stars(up))
    links = _persisted(_stars(first.coalesce(max(1, first.rdd.getNumPartitions() // 8))).distinct())

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = _persisted(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = mark(links)
        if now == before:
            break
        before = now
    named = graph.entities.select("name").join(links.select(F.col("u").alias("name"), F.col("v").alias("component")), "name", "left")
    named = named.select("name", F.coalesce("component", "name").alias("component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return named.join(sizes, "component").select("name", "component", "size")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """representative, size: distinct members, the representative included."""
    every = clusters.select("representative", F.explode(F.array("representative", "member")).alias("member")).distinct()
    return every.groupBy("representative").agg(F.count(F.lit(1)).alias("size"))


def label_color(label: Column) -> Column:
    """#rrggbb from the SHA-1 of a label: hue, saturation and lightness from its first three bytes."""
    byte = lambda i: F.conv(F.substring(F.sha1(label), 2 * i + 1, 2), 16, 10).cast("double") / 255
    hue, saturation, light = byte(0), 0.55 + byte(1) * 0.3, 0.45 + byte(2) * 0.25
    reach = saturation * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue * 12, F.lit(12.0))
        value = light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(F.round(value * 255, 9)).cast("bigint"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def view_model(graph: Graph) -> dict[str, DataFrame]:
    """The dashboard's tables: nodes, edges, top lists, statistics, isolated entities and components."""
    full = graph.repair()
    incident = lambda end, name: ordered.groupBy(F.col(end).alias("name")).agg(F.array_sort(F.collect_list("id")).alias(name))
    ordered = ordered_relations(full)
    nodes = degrees(full).join(neighbors(full), "name", "left").join(incident("subject", "outgoing"), "name", "left").join(incident("object", "incoming"), "name", "left")
    first = lambda clusters, key: clusters.groupBy(F.col("member").alias(key)).agg(F.min("representative").alias("cluster"))
    tagged = lambda kind: label_color(F.concat(F.lit(f"{kind}::"), F.col("cluster")))
    none = F.lit(None).cast("string").alias("cluster")
    nodes = nodes.join(first(graph.entity_clusters, "name"), "name", "left") if graph.entity_clusters is not None else nodes.select("*", none)
    nodes = nodes.withColumn("color", F.coalesce(tagged("entity"), F.lit("#64748b")))
    edges = ordered.join(first(graph.edge_clusters, "predicate"), "predicate", "left") if graph.edge_clusters is not None else ordered.select("*", none)
    edges = edges.withColumn("color", F.coalesce(tagged("predicate"), label_color(F.concat(F.lit("predicate::"), F.col("predicate")))))
    return {
        "nodes": nodes,
        "edges": edges.select("id", "subject", "predicate", "object", "cluster", "color"),
        "top_entities": top_entities(full),
        "top_predicates": top_predicates(full),
        "stats": statistics(full),
        "isolated": isolated(full),
        "components": component_table(full),
    }


def component_table(graph: Graph) -> DataFrame:
    """component, size, members: the view model's components, without its other tables."""
    return components(graph).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("name")).alias("members"))


def color_of(label: str) -> str:
    """Driver-side twin of :func:`label_color`, by the standard library's colour conversion, for tests."""
    h, s, v = hashlib.sha1(label.encode()).digest()[:3]
    rgb = colorsys.hls_to_rgb(h / 255, 0.45 + v / 255 * 0.25, 0.55 + s / 255 * 0.3)
    return "#" + "".join(f"{int(round(c * 255, 9)):02x}" for c in rgb)
