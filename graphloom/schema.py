"""Schemas of the engine's tables."""

from __future__ import annotations

ENTITIES = "name string"
PREDICATES = "predicate string"
TRIPLES = "subject string, predicate string, object string"
CLUSTERS = "representative string, member string"
METADATA = "entity string, value string"
GRAPH_JSON = (
    "entities array<string>, relations array<array<string>>, edges array<string>, "
    "entity_clusters map<string,array<string>>, edge_clusters map<string,array<string>>, entity_metadata map<string,array<string>>"
)
BLOCK = "struct<type:string,level:int,text:string,content:string>"
PAGE = f"skip boolean, type string, title string, page int, blocks array<{BLOCK}>"
STRUCTURED = "title string, sections array<struct<heading:string,level:int,content:string>>"
CHUNK = "source string, page int, chunk int, content string"
CACHE = "step string, model string, key string, value string"
SOURCE = "type_ord int, rank int, type string, text string, name string, source string, page int, score double"
