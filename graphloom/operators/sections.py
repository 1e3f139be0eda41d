"""Section assembly and cleaning as windows over ordered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def assemble(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections (doc, section, heading, level, content) of page records (doc, page, blocks).

    A heading opens a section; texts and tables before the first heading form one without; sections without
    content go.
    """
    blocks = pages.select(doc, "page", F.posexplode("blocks").alias("pos", "b")).select(doc, "page", "pos", "b.*").filter(F.col("type").isin("heading", "text", "table"))
    order = Window.partitionBy(doc).orderBy("page", "pos")
    heading = F.col("type") == "heading"
    numbered = blocks.withColumn("section", F.sum(heading.cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.when(~heading, F.struct("page", "pos", F.coalesce("content", F.lit("")).alias("content")))))
    made = numbered.groupBy(doc, "section").agg(
        F.max(F.when(heading, F.coalesce("text", F.lit("")))).alias("heading"),
        F.max(F.when(heading, F.coalesce("level", F.lit(1)))).alias("level"),
        F.concat_ws("", F.transform(parts, lambda p: F.concat(p["content"], F.lit("\n")))).alias("content"),
    )
    return made.filter(T.strip(F.col("content")) != "").select(doc, "section", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("level", F.lit(0)).alias("level"), "content")


def pick_title(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first non-empty title of each document by page."""
    return pages.groupBy(doc).agg(F.coalesce(F.min_by("title", F.when(F.col("title") != "", F.col("page"))), F.lit("")).alias("title"))


def clean(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Body sections of (doc, section, heading, level, content).

    A block heading drops everything up to the next numbered body heading; other unwanted headings drop their section;
    reference lists at the end of contents are cut.  The state before a row is the last event before it.
    """
    skip, body = T.is_skipped(F.col("heading")), T.opens_body(F.col("heading")) & ~T.is_skipped(F.col("heading"))
    event = F.when(T.is_skipped(F.col("heading")) & T.opens_block(F.col("heading")), 1).when(body, 0)
    before = Window.partitionBy(doc).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    marked = sections.withColumn("_event", event).withColumn("_inside", F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit(0)) == 1)
    kept = marked.filter(F.when(F.col("_inside"), body).otherwise(~skip)).withColumn("content", T.before_references(F.col("content")))
    return kept.filter(T.strip(F.col("content")) != "").drop("_event", "_inside")


def flatten(sections: DataFrame, titles: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, text): title, headings and trimmed contents, empty ones left out, a line each."""
    lines = F.array_sort(F.collect_list(F.struct("section", F.col("heading").alias("h"), T.strip(F.col("content")).alias("c"))))
    flat = sections.groupBy(doc).agg(F.flatten(F.transform(lines, lambda s: F.array(s["h"], s["c"]))).alias("parts"))
    if titles is not None:
        flat = titles.join(flat, doc, "left").withColumn("parts", F.concat(F.array("title"), F.coalesce("parts", F.array().cast("array<string>"))))
    return flat.select(doc, F.concat_ws("\n", F.filter("parts", lambda p: F.coalesce(p, F.lit("")) != "")).alias("text"))
