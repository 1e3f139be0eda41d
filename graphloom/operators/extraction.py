"""Extraction of entities and relations per chunk behind a content-hash cache; models are adapters."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.analytics import _persisted
from ..plans.graph import Graph
from .chunking import SLICE_ROWS

ENTITY_CAP = 150

#: text -> JSON answer; and (text, entities) -> JSON answer.
EntityExtractor = Callable[[str], str]
RelationExtractor = Callable[[str, list[str]], str]


def rule_entities(text: str) -> str:
    """Offline stand-in: capitalised words of three letters or more, in order of first use."""
    names = dict.fromkeys(re.findall(r"\b[A-Z][a-z]{2,}\b", text or ""))
    return json.dumps({"entities": [{"name": n, "type": "term"} for n in names]})


def rule_relations(text: str, entities: list[str]) -> str:
    """Offline stand-in: neighbouring entities of a sentence are related."""
    out, known = [], set(entities)
    for sentence in re.split(r"[.\n]", text or ""):
        found = [w for w in re.findall(r"\b[A-Z][a-z]{2,}\b", sentence) if w in known]
        out += [{"subject": a, "predicate": "near", "object": b} for a, b in zip(found, found[1:]) if a != b]
    return json.dumps({"relations": out})


def through_cache(rows: DataFrame, key: str, cache: DataFrame, call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], inputs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with column value, new cache rows): keys in *cache* (key, value) skip the call; each missing key is called once."""
    asked = rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti").select(key, *inputs)

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return call(pdf.iloc[i : i + SLICE_ROWS] for pdf in batches for i in range(0, len(pdf), SLICE_ROWS))

    fresh = _persisted(asked.mapInPandas(sliced, f"{key} string, value string"))
    known = cache.select(key, "value").unionByName(fresh)
    return rows.join(known, key, "left"), fresh


def cap_entities(found: DataFrame, cap: int | None = ENTITY_CAP) -> DataFrame:
    """At most *cap* names per chunk in their order (None: all of them), names with a double quote left out."""
    clean = F.filter("entities", lambda e: ~e.contains('"'))
    return found.withColumn("entities", clean if cap is None else F.slice(clean, 1, cap))


def known_endpoints(relations: DataFrame, entities: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Relations (chunk, subject, predicate, object) whose ends are entities (chunk, name) of the chunk."""
    ends = entities.select(chunk, "name").distinct()
    left = relations.join(ends.withColumnRenamed("name", "subject"), [chunk, "subject"], "left_semi")
    return left.join(ends.withColumnRenamed("name", "object"), [chunk, "object"], "left_semi")


#: What an isolated failure leaves in place of an answer; such answers are never cached.
FAILED = "\x00failed: "


def isolated(call: Callable[..., str]) -> Callable[..., str]:
    """*call*, with an exception turned into a marked answer."""

    def run(*args) -> str:
        try:
            return call(*args)
        except Exception as e:  # one failing chunk must not stop the others
            return f"{FAILED}{e}"

    return run


def extract_chunks(chunks: DataFrame, cache: DataFrame, model: str = "rules", entities: EntityExtractor = rule_entities, relations: RelationExtractor = rule_relations, cap: int | None = ENTITY_CAP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(names(chunk_id, name), triples(chunk_id, ...), failed(chunk_id, error), new cache rows) of chunks (chunk_id, text).

    A call that raises leaves its chunk in *failed*; the other chunks are not touched, and what failed is asked again next time.
    """
    safe_entities, safe_relations = isolated(entities), isolated(relations)

    def ask_entities(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "value": [safe_entities(t) for t in pdf["text"]]})

    def ask_relations(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "value": [safe_relations(t, list(e)) for t, e in zip(pdf["text"], pdf["entities"])]})

    bad = F.col("value").startswith(FAILED)
    error = lambda t: t.filter(bad).select("chunk_id", F.substring("value", len(FAILED) + 1, 1 << 20).alias("error"))
    keyed = chunks.select("chunk_id", "text", T.cache_key("entities", model, F.col("text")).alias("key"))
    answered, new_entities = through_cache(keyed, "key", cache, ask_entities, ["text"])
    answered = _persisted(answered.select("chunk_id", "text", "value"))
    named = _persisted(cap_entities(answered.filter(~bad).select("chunk_id", "text", T.parse_entities(F.col("value")).alias("entities")), cap))
    rekeyed = named.withColumn("key", T.cache_key("relations", model, F.col("text"), F.to_json("entities")))
    related, new_relations = through_cache(rekeyed, "key", cache, ask_relations, ["text", "entities"])
    related = _persisted(related.select("chunk_id", "value"))
    names = named.select("chunk_id", F.explode("entities").alias("name"))
    triples = known_endpoints(related.filter(~bad).select("chunk_id", F.inline(T.parse_relations(F.col("value")))), names)
    return names, triples, error(answered).unionByName(error(related)), new_entities.unionByName(new_relations).filter(~bad)


def extract(chunks: DataFrame, cache: DataFrame, model: str = "rules", entities: EntityExtractor = rule_entities, relations: RelationExtractor = rule_relations) -> tuple[Graph, DataFrame]:
    """(graph, new cache rows) of chunks (chunk_id, text): entities, cap, relations keyed by text and entities, end check."""

    def ask_entities(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "value": [entities(t) for t in pdf["text"]]})

    def ask_relations(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "value": [relations(t, list(e)) for t, e in zip(pdf["text"], pdf["entities"])]})

    keyed = chunks.select("chunk_id", "text", T.cache_key("entities", model, F.col("text")).alias("key"))
    answered, new_entities = through_cache(keyed, "key", cache, ask_entities, ["text"])
    answered = _persisted(answered.select("chunk_id", "text", T.parse_entities(F.col("value")).alias("entities")))
    named = _persisted(cap_entities(answered))
    rekeyed = named.withColumn("key", T.cache_key("relations", model, F.col("text"), F.to_json("entities")))
    related, new_relations = through_cache(rekeyed, "key", cache, ask_relations, ["text", "entities"])
    rows = _persisted(related.select("chunk_id", F.inline(T.parse_relations(F.col("value")))))
    ends = named.select("chunk_id", F.explode("entities").alias("name"))
    triples = known_endpoints(rows, ends)
    return Graph.of(triples, ends.select("name")), new_entities.unionByName(new_relations)


def cache_hits(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One row: hits and misses of the keys."""
    marked = rows.select(key).join(cache.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    return marked.agg(F.count_if(F.col("_hit")).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))


def token_usage(calls: DataFrame) -> DataFrame:
    """One row: summed prompt, completion and total tokens; nulls count as zero."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return calls.agg(*map(total, ("prompt_tokens", "completion_tokens", "total_tokens")))


def flatten_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, text): user and assistant turns as "role: text" lines in order."""
    kept = turns.filter(F.col("role").isin("user", "assistant"))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return kept.groupBy("conv_id").agg(F.concat_ws("\n", F.transform(lines, lambda s: s["line"])).alias("text"))


def latest_pages(lines: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Resume scan: of repeated page records (*keys*, line_no, ...) the last line of each page."""
    other = [c for c in lines.columns if c not in keys]
    newest = lines.groupBy(*keys).agg(F.max_by(F.struct(*other), "line_no").alias("r"))
    return newest.select(*keys, "r.*")
