"""Chunking as a stream: documents arrive, chunks are appended.

A document is a row, so the query keeps no state: no watermark is needed, late documents
are as good as any, and exactly-once follows from the source's offsets and a file sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.chunking import chunk_documents, chunk_markdown
from ..sources.documents import decode_documents


def read_texts(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """``doc_id, text`` of files that arrive in a folder, one document each."""
    files = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", max_files).text(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def chunk_stream(docs: DataFrame, kind: str = "markdown", **options) -> DataFrame:
    """Chunks of a stream of ``doc_id, text``: Markdown, or JSON of parsed documents."""
    if kind == "markdown":
        return chunk_markdown(docs, **options)
    if kind == "json":
        return chunk_documents(decode_documents(docs, "text"), **options)
    raise ValueError("kind is markdown or json")


def start(chunks: DataFrame, path: str, checkpoint: str, seconds: int = 10) -> StreamingQuery:
    """Append chunks to Parquet files in ``path``."""
    writer = chunks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start(path)
