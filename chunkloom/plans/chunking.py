"""Whole documents to chunks, a document a row: no shuffle, exact sequential semantics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import embedder
from ..functions.rows import by_row
from ..sources.markdown import parse_markdown
from .kernel import Chunk, Element, Options, chunk_elements

CHUNK = (
    "struct<sequence:int,content:string,token_count:int,page_numbers:array<int>,span_start:int,span_end:int,"
    "chunking_method:string,parent_chunk_id:string,dominant_type:string,block_sequence:int,"
    "has_code:boolean,has_math:boolean,has_table:boolean,metadata:string>"
)
MARKDOWN_ELEMENT = "struct<kind:string,content:string,metadata:string>"


def _row(c: Chunk) -> dict:
    out = dict(vars(c))
    out["metadata"] = json.dumps(c.metadata, ensure_ascii=False)
    return out


def _chunker(decode, options: Options, model_dir: str | None):
    @by_row(f"array<{CHUNK}>")
    def run(doc: str | None) -> list[dict] | None:
        return None if doc is None else [_row(c) for c in chunk_elements(decode(doc), options, embedder(model_dir))]

    return run


def _from_json(text: str) -> list[Element]:
    return [Element(e["k"], e.get("c") or "", e.get("p") or 0, json.loads(e["m"]) if e.get("m") else {}) for e in json.loads(text)]


def _options(max_tokens: int | None, overlap_tokens: int | None, threshold: float | None) -> Options:
    given = {"max_tokens": max_tokens, "overlap_tokens": overlap_tokens, "boundary_threshold": threshold}
    return Options(**{k: v for k, v in given.items() if v is not None})


def spread(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` over all cores, where a plain file scan has fewer partitions than there are
    (small files, few row groups). Anything larger, derived or streamed stays as it is."""
    if docs.isStreaming:
        return docs
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, id_col) if docs.rdd.getNumPartitions() < cores else docs


def chunk_documents(docs: DataFrame, *, max_tokens: int | None = None, overlap_tokens: int | None = None, boundary_threshold: float | None = None, model_dir: str | None = None) -> DataFrame:
    """Chunks of document rows ``doc_id, pages``: ``doc_id`` and the fields of a chunk.

    Documents without elements have no chunks. Elements with null content count as empty.
    """
    parts = F.flatten(F.transform("pages", lambda p: F.transform(p["elements"], lambda e: F.struct(e["element_type"].alias("k"), e["content"].alias("c"), e["page"].alias("p"), e["metadata"].alias("m")))))
    run = _chunker(_from_json, _options(max_tokens, overlap_tokens, boundary_threshold), model_dir)
    return docs.select("doc_id", F.explode(run(F.to_json(parts))).alias("c")).select("doc_id", "c.*")


def chunk_markdown(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, page: int = 1, max_tokens: int | None = None, overlap_tokens: int | None = None, boundary_threshold: float | None = None, model_dir: str | None = None) -> DataFrame:
    """Chunks of Markdown texts; null and blank ones have none."""
    decode = lambda text: [Element(k, c, page, m or {}) for k, c, m in parse_markdown(text)]
    run = _chunker(decode, _options(max_tokens, overlap_tokens, boundary_threshold), model_dir)
    docs = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return docs.select("doc_id", F.explode(run(F.col("text"))).alias("c")).select("doc_id", "c.*")


def markdown_elements(text: Column) -> Column:
    """Elements of a Markdown text, as an array column."""

    @by_row(f"array<{MARKDOWN_ELEMENT}>")
    def parse(text: str | None) -> list[dict]:
        return [{"kind": k, "content": c, "metadata": json.dumps(m) if m else None} for k, c, m in parse_markdown(text)]

    return parse(text)


def markdown_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", page: int = 1) -> DataFrame:
    """Document rows of Markdown texts, with one page each."""
    box = F.struct(*[F.lit(v).alias(k) for k, v in (("x_min", 0.0), ("y_min", 0.0), ("x_max", 1000.0), ("y_max", 1000.0))])
    element = lambda e: F.struct(e["kind"].alias("element_type"), e["content"].alias("content"), box.alias("bbox"), F.lit(page).alias("page"), F.lit(1.0).alias("confidence"), e["metadata"].alias("metadata"))
    parsed = docs.select(F.col(id_col).alias("doc_id"), markdown_elements(F.col(text_col)).alias("es"))
    only = F.struct(F.lit(page).alias("page_number"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), F.transform("es", element).alias("elements"))
    return parsed.select("doc_id", F.array(only).alias("pages"), F.lit('{"source":"markdown"}').alias("metadata"))
