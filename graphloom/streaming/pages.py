"""Incremental ingestion: a stream of page texts to chunks, exactly once per file, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_pages


def stream_chunks(spark: SparkSession, source: str, schema: str, text: str = "text", size: int = 800, overlap: int = 120, max_files: int = 1000) -> DataFrame:
    """Chunks of Parquet files as they arrive under *source*."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return chunk_pages(pages, size, overlap, text)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, then stop; a restart goes on after the last committed batch."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
