"""Chunks to records, files and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys of a chunk's record, in order.
RECORD = (
    "sequence", "content", "token_count", "page_numbers", "span_start", "span_end", "chunking_method",
    "parent_chunk_id", "dominant_type", "block_sequence", "has_code", "has_math", "has_table", "metadata",
)


#: All keys stand in a record, those without a value too.
_WHOLE = {"ignoreNullFields": "false"}


def _record() -> list[Column]:
    """Fields of a record; metadata is an object, empty if there is none."""
    metadata = F.parse_json(F.coalesce("metadata", F.lit("{}"))).alias("metadata")
    return [metadata if c == "metadata" else F.col(c) for c in RECORD]


def records(chunks: DataFrame) -> DataFrame:
    """``doc_id, sequence, record``: each chunk as a JSON object of all keys."""
    return chunks.select("doc_id", "sequence", F.to_json(F.struct(*_record()), _WHOLE).alias("record"))


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """One object a line, a file a task."""
    records(chunks).select(F.col("record").alias("value")).write.text(path)


def as_json(chunks: DataFrame) -> DataFrame:
    """``doc_id, json``: an array of all chunks of each document, in order."""
    row = F.struct("sequence", F.to_json(F.struct(*_record()), _WHOLE).alias("record"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["record"])
    return chunks.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("json"))


def summary(chunks: DataFrame) -> DataFrame:
    """``doc_id, sequence, line``: type, size, heading and beginning of each chunk."""
    preview = F.substring(F.btrim(F.regexp_replace("content", r"(?U)\s+", " ")), 1, 70)
    heading = F.coalesce(F.get_json_object("metadata", "$.nearest_heading"), F.lit(""))
    line = F.format_string("[%3d] %-13s %5d tok  %-30s %s", "sequence", "dominant_type", "token_count", F.substring(heading, 1, 30), preview)
    return chunks.select("doc_id", "sequence", line.alias("line"))


def responses(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, num_chunks, avg_tokens`` for every document, 0 of both without chunks."""
    totals = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("token_count").alias("mean"))
    out = docs.select("doc_id").join(totals, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("num_chunks"), F.coalesce("mean", F.lit(0.0)).alias("avg_tokens"))


def with_parent(chunks: DataFrame) -> DataFrame:
    """Add ``parent_sequence`` to the parts of a divided block: its parent's sequence."""
    divided = F.get_json_object("metadata", "$.has_children") == "true"
    last = F.last(F.when(divided, F.col("sequence")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("sequence"))
    return chunks.withColumn("parent_sequence", F.when(F.col("block_sequence").isNotNull(), last))
