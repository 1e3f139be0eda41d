"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import text as T
from .operators import chunking, dedup, extraction, retrieval, sections
from .plans import analytics
from .plans.analytics import _persisted
from .plans.graph import Graph, collapse, merge, rewrite, sanitize_predicate, sink_edges
from .service import DomainService
from .sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


_PLACES = """
select n_name as subject, 'part_of' as predicate, r_name as object from nation join region on n_regionkey = r_regionkey
union select s_name, 'located_in', n_name from supplier join nation on s_nationkey = n_nationkey
union select c_name, 'located_in', n_name from customer join nation on c_nationkey = n_nationkey"""
_KG = f"""with kg as ({_PLACES}
union select s_name, 'supplies_' || l_returnflag, 'Part#' || l_partkey from lineitem join supplier on l_suppkey = s_suppkey),
ents as (select subject as name from kg union select object from kg)"""
_SMALL = f"with kg as ({_PLACES}), ents as (select subject as name from kg union select object from kg)"
_PAIRS = """pairs as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity
  from embeddings a join embeddings b on a.vec_id < b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4 - 1e-12)"""
_SIM = f"""with recursive {_PAIRS},
ents as (select 'v' || vec_id as name from embeddings),
kg as (select 'v' || a as subject, 'similar' as predicate, 'v' || b as object from pairs)"""


# --- graph set algebra ---


@query(_KG + " select subject, predicate, object from kg")
def kg_triples(spark, sf):
    return X.kg(spark, sf).triples


@query(_KG + " select distinct predicate from kg")
def kg_vocab(spark, sf):
    return X.kg(spark, sf).predicates


@query(_KG + " select name from ents")
def kg_entities(spark, sf):
    return X.kg(spark, sf).entities


@query(_KG + ", c as (select subject as src, object as dst, arg_max(predicate, predicate) as relation, min(predicate) as pos from kg group by all) select * from c")
def kg_digraph_collapse(spark, sf):
    return collapse(X.kg(spark, sf).triples)


@query(_KG + " select 'e' as kind, name from ents union all select 'p', predicate from (select distinct predicate from kg) union all select 't', count(*)::varchar from kg")
def kg_merge(spark, sf):
    """Merge of three graphs that overlap; merging again changes nothing."""
    places, supplies = X.place_triples(spark, sf), X.supply_triples(spark, sf)
    g = merge([Graph.of(places), Graph.of(supplies), Graph.of(places.filter(F.col("predicate") == "part_of"))])
    row = lambda k, c: [F.lit(k).alias("kind"), c.alias("name")]
    return g.entities.select(*row("e", F.col("name"))).unionByName(g.predicates.select(*row("p", F.col("predicate")))).unionByName(g.triples.agg(F.count(F.lit(1)).cast("string").alias("n")).select(*row("t", F.col("n"))))


@query(_SMALL + " select name from ents union select 'lonely'")
def kg_repair(spark, sf):
    t = X.place_triples(spark, sf)
    broken = Graph(spark.createDataFrame([("lonely",)], "name string"), spark.createDataFrame([], "predicate string"), t)
    return broken.repair().entities


@query(_KG + """, s as (select distinct predicate || '-' || left(object, 1) as p from kg)
select p, case when regexp_replace(p, '[^0-9A-Za-z_一-鿿]', '_', 'g') similar to '[0-9].*' then 'REL_' else '' end || regexp_replace(p, '[^0-9A-Za-z_一-鿿]', '_', 'g') as rel_type from s""")
def kg_predicate_sanitize(spark, sf):
    p = X.kg(spark, sf).triples.select(F.concat("predicate", F.lit("-"), F.substring("object", 1, 1)).alias("p")).distinct()
    return p.select("p", sanitize_predicate(F.col("p")).alias("rel_type"))


@query(_KG + """ select subject, regexp_replace(predicate, '[^0-9A-Za-z_一-鿿]', '_', 'g') as rel_type, object, max(predicate) as predicate
from kg where subject <> 'Supplier#1' group by all""")
def kg_sink_dedupe(spark, sf):
    g = X.kg(spark, sf)
    return sink_edges(Graph(g.entities.filter("name <> 'Supplier#1'"), g.predicates, g.triples.filter("subject <> 'Supplier#1'")))


@query(_SMALL + """, m as (select name, case when name like 'Customer#%' then 'Customer' else name end as canonical from ents)
select distinct a.canonical as subject, case predicate when 'located_in' then 'in' else predicate end as predicate, b.canonical as object
from kg join m a on subject = a.name join m b on object = b.name""")
def kg_rewrite_canonical(spark, sf):
    g = X.places(spark, sf)
    names = g.entities.filter(F.col("name").startswith("Customer#")).select("name", F.lit("Customer").alias("canonical"))
    return rewrite(g, names, spark.createDataFrame([("located_in", "in")], "name string, canonical string")).triples


@query(_SMALL + " select n.name as name, count(t.subject)::bigint as n from ents n left join kg t on t.object = n.name where n.name not like 'Customer#%' group by all")
def kg_sql_passthrough(spark, sf):
    return sinks.query_graph(X.places(spark, sf), "select n.name, count(t.subject) as n from {nodes} n left join {triples} t on t.object = n.name where n.name not like 'Customer#%' group by n.name")


# --- analytics ---

_DEGREE = """, deg as (select name, count(k.e)::bigint as degree, coalesce(sum(i), 0)::bigint as in_degree, coalesce(sum(o), 0)::bigint as out_degree
from ents left join (select subject as e, 0 as i, 1 as o from kg union all select object, 1, 0 from kg) k on name = e group by name)"""


@query(_KG + _DEGREE + " select * from deg")
def kg_degree(spark, sf):
    return analytics.degrees(X.kg(spark, sf))


@query(_KG + _DEGREE + " select * from deg order by degree desc, lower(name), name limit 10")
def kg_top_entities(spark, sf):
    return analytics.top_entities(X.kg(spark, sf))


@query(_KG + " select predicate, count(*)::bigint as n from kg group by predicate order by n desc, lower(predicate), predicate limit 10")
def kg_top_predicates(spark, sf):
    return analytics.top_predicates(X.kg(spark, sf))


@query(_KG + """ select (select count(*) from ents)::bigint as n_entities, count(distinct predicate)::bigint as n_predicates, count(*)::bigint as n_triples,
round(2.0::double * count(*) / (select count(*) from ents), 2) as average_degree,
round(count(*) / ((select count(*) from ents)::double * ((select count(*) from ents) - 1)), 3) as density from kg""")
def kg_stats(spark, sf):
    return analytics.statistics(X.kg(spark, sf))


@query(_SIM + " select name from ents where name not in (select subject from kg union select object from kg)")
def kg_isolated(spark, sf):
    return analytics.isolated(X.sim(spark, sf))


@query(_SMALL + """ select name, array_to_string(list_sort(list(distinct other)), ',') as neighbors
from (select subject as name, object as other from kg union all select object, subject from kg) group by name""")
def kg_neighbors(spark, sf):
    return analytics.neighbors(X.places(spark, sf)).select("name", F.array_join("neighbors", ",").alias("neighbors"))


@query(_SIM + """, reach as (select name, name as other from ents union select r.name, e.t from reach r
  join (select subject as f, object as t from kg union all select object, subject from kg) e on e.f = r.other),
comp as (select name, min(other) as component from reach group by name)
select name, component, count(*) over (partition by component)::bigint as size from comp""")
def kg_components(spark, sf):
    return analytics.components(X.sim(spark, sf))


@query(_KG + """ select 'e' || (row_number() over (order by lower(predicate), lower(subject), lower(object), predicate, subject, object) - 1) as id, subject, predicate, object from kg""")
def kg_relation_ids(spark, sf):
    return analytics.ordered_relations(X.kg(spark, sf))


@query("""with c as (select 'b' || p_brand as representative, p_name as member from part)
select representative, count(distinct m)::bigint as size from (select representative, member as m from c union all select representative, representative from c) group by 1""")
def kg_cluster_sizes(spark, sf):
    return analytics.cluster_sizes(X.table(spark, sf, "part").select(F.concat(F.lit("b"), "p_brand").alias("representative"), F.col("p_name").alias("member")))


# --- graph retrieval ---

_SEEDS = "seeds as (select vec_id as query_id, 'v' || vec_id as name, 1.0::double / (1 + vec_id) as score from embeddings where vec_id % 50 = 0)"


def _seeds(spark, sf) -> DataFrame:
    """Each vector whose id is divisible by 50 as a query with itself as seed."""
    ids = X.table(spark, sf, "embeddings").filter("vec_id % 50 = 0")
    return ids.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), (F.lit(1.0) / (1 + F.col("vec_id"))).alias("score"))


@query(_SIM + f""", {_SEEDS}, both_ways as (select subject as f, object as t from kg union all select object, subject from kg),
near as (select query_id, name from seeds union select query_id, t from both_ways join seeds on f = name)
select distinct query_id, subject as src, predicate as relation, object as dst from kg join near on name in (subject, object)""")
def kg_khop_context(spark, sf):
    return retrieval.khop_context(X.sim(spark, sf).triples, _seeds(spark, sf), 2)


_DECAY = """both_ways as (select subject as f, object as t from kg union all select object, subject from kg),
hop as (select query_id, t as name, 0.5 * max(score) as score from both_ways join seeds s on f = name where not exists (select 1 from seeds o where o.query_id = s.query_id and o.name = t) group by all),
near as (select query_id, name, score from seeds union all select * from hop),
scored as (select query_id, subject as src, predicate as relation, object as dst, greatest(0, max(n.score)) as score from kg join near n on n.name in (subject, object) group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, src, relation, dst) as rank from scored)"""


@query(_SIM + f""", {_SEEDS}, {_DECAY} select query_id, rank::int as rank, src, relation, dst, round(score, 6) as score from ranked where rank <= 40""")
def kg_subgraph_decay(spark, sf):
    return retrieval.decayed_subgraph(X.sim(spark, sf).triples, _seeds(spark, sf)).withColumn("score", F.round("score", 6))


# --- text ---


@query("""select conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn, role || ': ' || coalesce(text, '')) as text from conversations
where role in ('user', 'assistant') group by conv_id""")
def conv_flatten(spark, sf):
    return extraction.flatten_conversations(X.table(spark, sf, "conversations"))


_SPLIT = r"""regexp_replace({t}, '([。！？；!?;])\s*|\n+', '\1' || chr(1), 'g')"""


@query(f"""with s as (select doc_id, unnest(list_filter(list_transform(string_split({_SPLIT.format(t='text')}, chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')) as sentence from documents)
select doc_id, count(*)::bigint as n, md5(string_agg(sentence, '|' order by sentence)) as digest from s group by doc_id""")
def doc_sentences(spark, sf):
    s = X.table(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.concat_ws("|", F.array_sort(F.collect_list("sentence")))).alias("digest"))


@query()
def doc_chunks_kg(spark, sf):
    """Sentence chunks of at most 500 characters; the tests hold them against a sequential version on whole tables."""
    return chunking.chunk_documents(X.table(spark, sf, "documents").select("doc_id", "text"), 500)


@query()
def doc_chunks_rag(spark, sf):
    """Overlapping passages; the tests hold them against a sequential version on whole tables."""
    return chunking.chunk_pages(X.table(spark, sf, "documents").select("doc_id", "text"))


@query("""select x as term, count(distinct doc_id)::bigint as df from (select doc_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) as x
from (select doc_id, trim(lower(text), ' ' || chr(10)) as t from documents)) group by 1""")
def doc_bigram_df(spark, sf):
    d = X.table(spark, sf, "documents")
    return retrieval.document_frequencies(retrieval.postings(d, T.plain(F.col("text"))))


def bm25_sql(tokens: str, asked: str) -> str:
    """bm(query_id, doc_id, bm25) from selects of (doc_id, term) and (query_id, term)."""
    return f"""toks as ({tokens}),
len as (select doc_id, count(*) as dl from toks group by 1), corpus as (select (select count(*) from docs) as n, (select count(*) from toks)::double / (select count(*) from docs) as avgdl),
post as (select doc_id, term, count(*) as tf from toks group by all),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as r from post, corpus group by term, n),
idf as (select term, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw),
asked as (select query_id, term, count(*) as times from ({asked}) group by all),
bm as (select query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as bm25 from asked join post using (term) join idf using (term) join len using (doc_id), corpus group by all)"""


_WORDS = r"string_split_regex(lower(trim(text, ' ' || chr(10))), '\s+')"
_BM25 = "docs as (select doc_id from documents), " + bm25_sql(f"select doc_id, unnest({_WORDS}) as term from documents", f"select item_id as query_id, unnest({_WORDS}) as term from benchmark where item_id % 50 = 0")


def _bm25(spark, sf) -> DataFrame:
    """Every benchmark item whose id is divisible by 50 against all documents."""
    d, q = X.table(spark, sf, "documents"), X.table(spark, sf, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(d, q, T.tokens(F.col("text")), T.tokens(F.col("text")))


@query(f"with {_BM25} select query_id, doc_id, round(bm25, 6) as bm25 from bm")
def bm25_scores(spark, sf):
    return _bm25(spark, sf).withColumn("bm25", F.round("bm25", 6))


@query(f"with {_BM25}, r as (select *, row_number() over (partition by query_id order by round(bm25, 6) desc, doc_id) as rank from bm) select query_id, doc_id, round(bm25, 6) as bm25, rank::int as rank from r where rank <= 4")
def bm25_topk(spark, sf):
    return retrieval.top_k(_bm25(spark, sf).withColumn("bm25", F.round("bm25", 6)), 4, "bm25")


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return e, e.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_COS = """cs as (select q.vec_id as query_id, e.vec_id as doc_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as cosine
from embeddings e join embeddings q on q.vec_id % 50 = 0)"""


@query(f"with {_COS}, r as (select *, row_number() over (partition by query_id order by cosine desc, doc_id) as rank from cs) select query_id, doc_id, cosine, rank::int as rank from r where rank <= 8")
def vec_topk(spark, sf):
    return retrieval.nearest(*_vectors(spark, sf), 8)


@query(f"with {_PAIRS} select a, b, round(similarity, 6) as similarity from pairs")
def vec_pairs(spark, sf):
    return X.sim_pairs(spark, sf).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {_PAIRS}, nb as (select v.vec_id as id, coalesce(list(p.a) filter (where p.a is not null), []) as lower from embeddings v left join pairs p on p.b = v.vec_id group by 1),
o as (select list(struct_pack(id := id, lower := lower) order by id) as xs from nb),
k as (select list_reduce(list_prepend([]::bigint[], list_transform(xs, lambda x: list_prepend(x.id, x.lower))), lambda acc, x: case when list_has_any(acc, x[2:]) then acc else list_append(acc, x[1]) end) as kept from o)
select id as item, coalesce((select min(p.a) from pairs p, k where p.b = nb.id and list_contains(k.kept, p.a)), id)::bigint as representative from nb""")
def vec_dedup_greedy(spark, sf):
    return dedup.greedy_selection(X.table(spark, sf, "embeddings"), X.sim_pairs(spark, sf), "vec_id")


@query()
def vec_assign_capacity(spark, sf):
    """Balanced clusters of up to 128 around one k-means centre per 128 rows; held against a sequential version in the tests."""
    e = X.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    n = e.count()
    centers = dedup.kmeans_centers(e, max(1, n // 128)) if n else spark.createDataFrame([], "cluster int, center array<double>")
    return dedup.assign_with_capacity(e, centers, 128, "vec_id")


_HYBRID = f"""{_BM25}, {_COS}, best as (select query_id, max(bm25) as top from bm group by 1),
h as (select c.query_id, c.doc_id, round(0.7 * cosine + 0.3 * case when top > 0 then coalesce(bm25, 0) / top else 0 end, 9) as score from cs c left join bm using (query_id, doc_id) left join best using (query_id)),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from h)"""


def _hybrid(spark, sf, k: int) -> DataFrame:
    e, q = _vectors(spark, sf)
    return retrieval.hybrid_top_k(e, q, _bm25(spark, sf), k)


@query(f"with {_HYBRID} select query_id, doc_id, score, rank::int as rank from r where rank <= 4")
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf, 4)


_BIGRAMS = "unnest(case when length({c}) > 1 then list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)) else [{c}] end) as term"
_NAMES = "docs as (select 'v' || vec_id as doc_id from embeddings), " + bm25_sql(f"select doc_id, {_BIGRAMS.format(c='doc_id')} from docs", f"select vec_id as query_id, {_BIGRAMS.format(c=chr(39) + 'v' + chr(39) + ' || vec_id')} from embeddings where vec_id % 50 = 0")
_LINKS = f"""{_NAMES}, {_COS}, best as (select query_id, max(bm25) as top from bm group by 1),
h as (select c.query_id, 'v' || c.doc_id as name, round(0.7 * cosine + 0.3 * case when top > 0 then coalesce(bm25, 0) / top else 0 end, 9) as score from cs c left join bm on bm.query_id = c.query_id and bm.doc_id = 'v' || c.doc_id left join best on best.query_id = c.query_id),
linked as (select *, row_number() over (partition by query_id order by score desc, name) as rank from h)"""


def _service(spark, sf) -> tuple[DomainService, DataFrame]:
    """A service over the SIM graph whose entities have the table's vectors, and its queries: every vector whose id is divisible by 50, asked by name."""
    e, q = _vectors(spark, sf)
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    service = DomainService(spark, None, X.sim(spark, sf), dedup.hashing_embedder(), entities=e.select(name("doc_id").alias("doc_id"), "embedding"))
    return service, q.select("query_id", name("query_id").alias("text"), "query_vector")


@query(f"with {_LINKS} select query_id, rank::int as rank, name, score from linked where rank <= 8")
def entity_link(spark, sf):
    service, queries = _service(spark, sf)
    return service.entity_hits(queries)


_FUSION = f"""{_SIM.replace('with recursive ', '')}, {_LINKS}, seeds as (select query_id, name, score from linked where rank <= 8), {_DECAY}"""


@query(f"""with recursive hy as (with {_HYBRID} select * from r), {_FUSION}
select query_id, 0 as type_ord, 'chunk' as type, rank::int as rank, case when length(trim(text, ' ' || chr(10))) > 160 then left(trim(text, ' ' || chr(10)), 160) || '…' else trim(text, ' ' || chr(10)) end as text, source, score
from hy join documents using (doc_id) where rank <= 4
union all select query_id, 1, 'entity', rank::int, name, null, score from linked where rank <= 8
union all select query_id, 2, 'triple', rank::int, src || ' -[' || relation || ']-> ' || dst, null, score from ranked where rank <= 40""")
def source_fusion(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text", "source", F.lit(None).cast("int").alias("page"))
    chunks = _hybrid(spark, sf, 4).join(docs, "doc_id")
    service, queries = _service(spark, sf)
    entities = _persisted(service.entity_hits(queries))
    triples = retrieval.decayed_subgraph(service.graph.triples, entities)
    fused = retrieval.fuse_sources(chunks, entities, triples)
    return fused.select("query_id", "type_ord", "type", "rank", F.coalesce("text", "name").alias("text"), "source", "score")


# --- model answers and cache ---


@query("select event_id, (props::json->>'$.k')::bigint as k from events")
def json_props(spark, sf):
    return X.table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""select p_partkey, case p_partkey % 5 when 0 then p_name || '|' || p_brand when 4 then '' else trim(p_name) end as names from part""")
def llm_entities_parse(spark, sf):
    p = X.table(spark, sf, "part")
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    answer = (
        F.when(k == 0, F.to_json(F.struct(F.array(F.struct(name.alias("name"), F.lit("part").alias("type")), F.struct(F.col("p_brand").alias("name"), F.lit("brand").alias("type"))).alias("entities"))))
        .when(k == 1, F.to_json(F.struct(F.array(name).alias("entities"))))
        .when(k == 2, F.to_json(F.array(F.struct(F.concat(F.lit(" "), name).alias("entity")))))
        .when(k == 3, F.to_json(F.array(name)))
        .otherwise(F.concat(F.lit('{"entities": ['), name))
    )
    return p.select("p_partkey", F.array_join(T.parse_entities(answer), "|").alias("names"))


@query("""select s_suppkey, s_name as subject, 'in' as predicate, 'nation' || s_nationkey as object from supplier where s_suppkey % 3 <> 2 and s_nationkey % 2 = 0""")
def llm_relations_parse(spark, sf):
    s = X.table(spark, sf, "supplier")
    rel = F.struct(F.col("s_name").alias("subject"), F.when(F.col("s_suppkey") % 3 != 2, "in").alias("predicate"), F.concat(F.lit("nation"), "s_nationkey").alias("object"))
    answer = F.when(F.col("s_suppkey") % 3 == 0, F.to_json(F.array(rel))).otherwise(F.to_json(F.struct(F.array(rel).alias("relations"))))
    rows = s.select("s_suppkey", F.inline(T.parse_relations(answer)))
    even = s.filter("s_nationkey % 2 = 0").select("s_suppkey", F.explode(F.array("s_name", F.concat(F.lit("nation"), "s_nationkey"))).alias("name"))
    return extraction.known_endpoints(rows, even, "s_suppkey")


@query("select doc_id, sha256('entities' || chr(0) || 'rules' || chr(0) || text) as key from documents")
def cache_key(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.cache_key("entities", "rules", F.col("text")).alias("key"))


@query("""with k as (select doc_id, sha256('entities' || chr(0) || 'rules' || chr(0) || text) as key from documents), c as (select distinct key from k where doc_id % 3 = 0)
select count(*) filter (where c.key is not null)::bigint as hits, count(*) filter (where c.key is null)::bigint as misses from k left join c using (key)""")
def cache_antijoin(spark, sf):
    keys = cache_key(spark, sf)
    return extraction.cache_hits(keys, keys.filter("doc_id % 3 = 0"))


#: Words as the rule adapter sees them: whole runs of letters, digits and underscores.
_NAMED = r"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}'))"


@query(f"""select doc_id::varchar as doc_id, unnest(list_distinct({_NAMED.format(t='text')})) as name from documents""")
def extract_rule_entities(spark, sf):
    """The rule extractor over whole documents: calls, answers, parsing, no cap."""
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    rows = docs.withColumn("key", T.cache_key("entities", "rules", F.col("text")))

    def ask(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "value": [extraction.rule_entities(t) for t in pdf["text"]]})

    answered, _ = extraction.through_cache(rows, "key", spark.createDataFrame([], "key string, value string"), ask, ["text"])
    return answered.select(F.col("chunk_id").alias("doc_id"), F.explode(T.parse_entities(F.col("value"))).alias("name"))


@query()
def extract_rule_graph(spark, sf):
    """Cache-through extraction over chunked documents with the offline rule adapters; held against direct calls in the tests."""
    chunks = chunking.chunk_documents(X.table(spark, sf, "documents").select("doc_id", "text"), readers.Config().chunk_size)
    chunks = chunks.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "text")
    graph, _ = extraction.extract(chunks, spark.createDataFrame([], "key string, value string"))
    return graph.triples


# --- sections ---


def _page_records(spark, sf) -> DataFrame:
    """Documents as page records: their first line is a heading, each other line a text block."""
    lines = F.split("text", "\n")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(1).alias("level"), text.alias("text"), text.alias("content"))
    blocks = F.transform(lines, lambda x, i: F.when(i % 4 == 0, block("heading", x)).otherwise(block("text", x)))
    return X.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), blocks.alias("blocks"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
s as (select doc_id, i // 4 + 1 as section, max(x) filter (where i % 4 = 0) as heading, string_agg(x || chr(10), '' order by i) filter (where i % 4 <> 0) as content from l group by all)
select doc_id, section::bigint as section, heading, 1 as level, content from s where trim(coalesce(content, ''), ' ' || chr(10)) <> ''""")
def page_sections(spark, sf):
    return sections.assemble(_page_records(spark, sf))


_SKIP = "|".join(f"(?:{p})" for p in T.SKIP_HEADINGS)
_BODY = r"^\s*\d+(\.\d+)+|^\s*第[一二三四五六七八九十百]+[章节]"
_REFERENCE = r"^\s*\[?\d+\]?\s*[、.．)）:：]?\s*[^\n]*(?:出版社|学报|期刊)"
_HEADS = ("1.1 {h}", "思 考 题", "实训项目", "{h}", "第二章 实训项目", "{h}", "2.1 {h}", "参考文献", "{h}", "3.10 {h}")


@query(rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
s as (select doc_id, i // 4 as section, max(x) filter (where i % 4 = 0) as h,
  string_agg(case when i % 4 = 2 and i // 4 % 3 = 0 then '[2] ' || x || ' 出版社' when i % 4 = 3 and i // 4 % 5 = 0 then '参考 文献' else x end || chr(10), '' order by i) filter (where i % 4 <> 0) as content from l group by all),
t as (select doc_id, section, content, case section % 10 {" ".join(f"when {i} then {' || '.join(q for q in (chr(39) + t.replace('{h}', '') + chr(39), 'h' if '{h}' in t else '') if q)}" for i, t in enumerate(_HEADS))} end as heading from s where trim(coalesce(content, ''), ' ' || chr(10)) <> ''),
n as (select *, regexp_replace(heading, '\s+', '', 'g') as hh from t),
e as (select *, regexp_matches(hh, '{_SKIP}') as skip, regexp_matches(hh, '{_BODY}') and not regexp_matches(hh, '{_SKIP}') as body, contains(hh, '实训项目') as block from n),
f as (select *, coalesce(last_value(case when skip and block then 1 when body then 0 end ignore nulls) over (partition by doc_id order by section rows between unbounded preceding and 1 preceding), 0) = 1 as inside from e),
k as (select *, string_split(content, chr(10)) as xs from f where case when inside then body else not skip end),
c as (select *, list_position(list_transform(xs, lambda x: regexp_matches(x, '{_REFERENCE}') or regexp_replace(x, '\s+', '', 'g') = '参考文献'), true) as hit from k),
d as (select *, case when hit > 0 then array_to_string(xs[:hit - 1], chr(10)) else content end as cut from c)
select doc_id, section::bigint as section, heading, md5(cut) as digest from d where trim(cut, ' ' || chr(10)) <> ''""")
def sections_clean(spark, sf):
    """Cleaning with block headings, numbered headings that end or do not end a block, unnumbered ones inside, and reference lists."""
    lines = F.split("text", "\n")
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), F.lit(1).alias("level"), x.alias("text"), x.alias("content"))
    section = lambda i: F.floor(i / 4)
    listed = lambda x, i: F.when((i % 4 == 2) & (section(i) % 3 == 0), F.concat(F.lit("[2] "), x, F.lit(" 出版社"))).when((i % 4 == 3) & (section(i) % 5 == 0), "参考 文献").otherwise(x)
    heads = lambda x, i: F.element_at(F.array(*[F.format_string(t.replace("{h}", "%s"), x) if "{h}" in t else F.lit(t) for t in _HEADS]), (section(i) % 10 + 1).cast("int"))
    blocks = F.transform(lines, lambda x, i: F.when(i % 4 == 0, block("heading", heads(x, i))).otherwise(block("text", listed(x, i))))
    pages = X.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), blocks.alias("blocks"))
    kept = sections.clean(sections.assemble(pages))
    return kept.select("doc_id", (F.col("section") - 1).alias("section"), "heading", F.md5("content").alias("digest"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
s as (select doc_id, i // 4 as section, max(x) filter (where i % 4 = 0) as h, trim(string_agg(x || chr(10), '' order by i) filter (where i % 4 <> 0), ' ' || chr(10)) as c from l group by all)
select doc_id, md5(string_agg(case when h = '' then '' else h || chr(10) end || c, chr(10) order by section)) as digest from s where coalesce(c, '') <> '' group by 1""")
def doc_flatten(spark, sf):
    flat = sections.flatten(sections.assemble(_page_records(spark, sf)))
    return flat.select("doc_id", F.md5("text").alias("digest"))
