"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, pseudonyms, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common
from graphloom.llm.decontaminate import drop_leaks
from graphloom.llm.packing import pack_documents
from graphloom.llm.pii import hide_private
from graphloom.llm.quality import keep_good
from graphloom.llm.similar import keep_one_of_each

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("private_data", hide_private),
    ("packing", pack_documents),
]

#: Robust estimates, similarity classes, keyed permutations and tokenizers are beyond SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written as Parquet to the shared folder and read again.

    A stage's scratch tables, and the result before it, are deleted once its own result is written.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"stage-{name}")
        with common.scratch_scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return docs
