"""Text functions as column expressions; Arrow kernels only where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Headings of sections that are left out, matched after white space is removed.
SKIP_HEADINGS = (
    "前言", "序言", "撰写目的", "编写目的", "本书的", "读者群", "新颖之处", "编制说明", "编委", "编写委员会",
    r"^(?:\d+)?(?:适用)?范围$", "规范[性型]?引用文件", "引用标准", "引用文件",
    "本章小结", "^小结$", "复习思考题", "思考题", "思题", "复习题", "习题", "学习目标", "学习要求", "学习重点",
    "实训", "仪器和设备", "场地与设备", "任务材料", "任务分解",
    "参考文献", "致谢", "后记",
)
# Block headings, numbered body headings, reference entries.
BLOCK_HEADING = "实训项目"
BODY_HEADING = r"^\s*\d+(?:\.\d+)+|^\s*第[一二三四五六七八九十百]+[章节]"
REFERENCE_LINE = r"^\s*\[?\d+\]?\s*[、.．)）:：]?\s*[^\n]*(?:出版社|学报|期刊)"

U = "(?U)"  # Unicode classes, as \s and \d have them elsewhere


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Without any white space (headings broken up by character recognition)."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), U + r"\s+", "")


def _cut(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda s: s != "")


def sentences(c: Column) -> Column:
    """Trimmed sentences for extraction: cut after 。！？；!?; with the blanks that follow, and at line ends."""
    return _cut(c, U + r"(?<=[。！？；!?;])\s*|\n+")


def passages(c: Column) -> Column:
    """Trimmed sentences for retrieval: cut right after the same marks or a line end."""
    return _cut(c, r"(?<=[。！？；!?;])|(?<=\n)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with *value* evaluated once, also where *body* uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams(c: Column) -> Column:
    """Character bigrams of the lower-cased, trimmed text; one character is a token, none are no tokens."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        pairs = F.zip_with(F.split(t, ""), F.slice(F.split(t, ""), F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, b))
        return F.when(n >= 2, F.slice(pairs, F.lit(1), n - 1)).when(n == 1, F.array(t)).otherwise(F.array().cast("array<string>"))

    return let(plain(c), cut)


def plain(c: Column) -> Column:
    """The text whose characters :func:`bigrams` pairs."""
    return strip(F.lower(c))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), U + r"\s+"), lambda t: t != "")


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def singular(word: Column) -> Column:
    """English singular by suffix rules (own rules; irregular nouns stay)."""
    w = F.lower(word)
    cut = lambda n, end="": F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(end))
    return (
        F.when(F.length(word) <= 3, word)
        .when(w.rlike("(?:ss|us|is)$"), word)
        .when(w.rlike("[^aeiou]ies$"), cut(3, "y"))
        .when(w.rlike("(?:ch|sh|x|z|ss)es$"), cut(2))
        .when(w.endswith("s"), cut(1))
        .otherwise(word)
    )


def singularize(c: Column) -> Column:
    return F.concat_ws(" ", F.transform(F.filter(F.split(c, U + r"\s+"), lambda t: t != ""), singular))


def is_skipped(heading: Column) -> Column:
    return squeeze(heading).rlike(U + "|".join(f"(?:{p})" for p in SKIP_HEADINGS))


def opens_block(heading: Column) -> Column:
    return squeeze(heading).rlike(BLOCK_HEADING)


def opens_body(heading: Column) -> Column:
    return squeeze(heading).rlike(U + BODY_HEADING)


def before_references(content: Column) -> Column:
    """Lines before the first reference entry or the line 参考文献."""
    lines = F.split(F.coalesce(content, F.lit("")), "\n")
    hit = F.array_position(F.transform(lines, lambda x: x.rlike(U + REFERENCE_LINE) | (squeeze(x) == "参考文献")), True)
    return F.when(hit > 0, F.array_join(F.slice(lines, F.lit(1), (hit - 1).cast("int")), "\n")).otherwise(content)


def excerpt(c: Column, n: int = 160) -> Column:
    t = strip(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def cache_key(step: str | Column, model: str | Column, *parts: Column) -> Column:
    """SHA-256 over step, model and parts, zero bytes between them; null parts are empty."""
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(col(x), F.lit("")) for x in (step, model, *parts)]), 256)


def unfence(c: Column) -> Column:
    """Text without a Markdown code fence around it."""
    t = strip(F.coalesce(c, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"```\s*$", "")
    return F.when(t.startswith("```"), inner).otherwise(t)


def parse_page(c: Column) -> Column:
    """Page record of a model's answer; what is not JSON becomes one text block."""
    body = unfence(c)
    record = F.from_json(body, "skip boolean, type string, title string, page int, blocks array<struct<type:string,level:int,text:string,content:string>>")
    fallback = F.named_struct(
        F.lit("skip"), F.lit(False), F.lit("type"), F.lit("content"), F.lit("title"), F.lit(""), F.lit("page"), F.lit(None).cast("int"),
        F.lit("blocks"), F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("level"), F.lit(None).cast("int"), F.lit("text"), F.lit(None).cast("string"), F.lit("content"), body)),
    )
    return F.when(F.try_parse_json(body).isNull(), fallback).otherwise(record)


def parse_entities(c: Column) -> Column:
    """Entity names of a model's answer in any of its four shapes; anything else gives none.

    Only an answer that is wholly {"entities": [{"name", "type"}, ...]} keeps names untrimmed.
    """
    v = F.try_parse_json(c)
    items = F.coalesce(F.try_variant_get(v, "$.entities", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda x, path: F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))
    name = lambda x: F.coalesce(text(x, "$"), F.nullif(text(x, "$.name"), F.lit("")), text(x, "$.entity"))
    strict = F.try_variant_get(v, "$.entities", "array<variant>").isNotNull() & F.forall(items, lambda x: text(x, "$.name").isNotNull() & text(x, "$.type").isNotNull())
    names = F.filter(F.transform(items, name), lambda n: n.isNotNull() & (n != ""))
    return F.when(strict, F.transform(items, lambda x: text(x, "$.name"))).otherwise(F.transform(names, strip))


def parse_relations(c: Column) -> Column:
    """array<struct<subject,predicate,object>> of a model's answer, rows with a missing or empty field left out."""
    v = F.try_parse_json(c)
    items = F.coalesce(F.try_variant_get(v, "$.relations", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = F.transform(items, lambda x: F.struct(*[F.try_variant_get(x, f"$.{k}", "string").alias(k) for k in ("subject", "predicate", "object")]))
    return F.filter(rows, lambda r: (F.coalesce(r["subject"], F.lit("")) != "") & (F.coalesce(r["predicate"], F.lit("")) != "") & (F.coalesce(r["object"], F.lit("")) != ""))


def triple_text(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat(subject, F.lit(" "), predicate, F.lit(" "), obj, F.lit("."))
