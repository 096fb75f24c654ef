"""Operators over the chunks of documents: ``doc_id, ord, content, token_count, ...``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.embed import embedder
from ..functions.rows import as_lists, by_row, pieces
from ..functions.text import collapse_spans
from ..plans.kernel import Chunk, merged


def headings_before(headings: Column, content: Column) -> Column:
    """Content behind its headings (an array), each taken off the content's beginning where
    it stands there before a line end or alone."""
    body = F.aggregate(
        headings,
        F.regexp_replace(content, r"(?U)^\s+", ""),
        lambda b, h: F.when((h != "") & ((b == h) | b.startswith(F.concat(h, F.lit("\n")))), F.regexp_replace(F.substr(b, F.length(h) + 1), r"^\n* *\n*", "")).otherwise(b),
    )
    return F.when(F.size(headings) > 0, F.concat_ws("\n\n", F.array_join(headings, "\n\n"), body)).otherwise(content)


def with_headings(chunks: DataFrame) -> DataFrame:
    """Put ``pending`` (an array of headings, null for none) before each chunk's content and
    count its tokens anew."""
    out = chunks.withColumn("content", F.when(F.col("pending").isNull(), F.col("content")).otherwise(headings_before(F.col("pending"), F.col("content"))))
    return out.withColumn("token_count", C.token_count("content")).drop("pending")


def with_trailing(chunks: DataFrame, trailing: DataFrame) -> DataFrame:
    """Append ``trailing`` (doc_id, headings) to the last chunk of its document; documents
    without chunks lose them."""
    last = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("ord"))) == 1
    out = chunks.withColumn("_last", last).join(trailing, "doc_id", "left")
    added = F.col("_last") & F.col("headings").isNotNull()
    out = out.withColumn("content", F.when(added, F.concat_ws("\n\n", "content", "headings")).otherwise(F.col("content")))
    return out.withColumn("token_count", F.when(added, C.token_count("content")).otherwise(F.col("token_count"))).drop("_last", "headings")


_MERGED = "array<struct<ord:bigint,content:string,token_count:bigint,page_numbers:array<int>,span_start:int,span_end:int,dominant_type:string>>"


def without_small(chunks: DataFrame, max_tokens: int, model_dir: str | None = None) -> DataFrame:
    """Merge small chunks into the nearest of their type, past blocks between them.

    A merge changes what the next chunk sees, before it and after it, so the chunks of a
    document go through one function in order. Chunks with ``divided`` true keep to
    themselves. Forward merges can put prose behind a block that it stood before.
    """
    fields = ("ord", "content", "token_count", "page_numbers", "span_start", "span_end", "dominant_type", "divided")
    rows = F.array_sort(F.collect_list(F.struct(*fields)))

    @by_row(_MERGED)
    def walk(rows: list[dict]) -> list[dict]:
        made = [Chunk(r["content"], int(r["token_count"]), [int(p) for p in r["page_numbers"]], r["span_start"], r["span_end"], "", r["dominant_type"], {"has_children": bool(r["divided"]), "ord": r["ord"]}) for r in rows]
        kept = merged(made, embedder(model_dir), max_tokens)
        return [{"ord": c.metadata["ord"], **{k: getattr(c, k) for k in fields[1:-1]}} for c in kept]

    groups = chunks.groupBy("doc_id").agg(rows.alias("rows"))
    return groups.select("doc_id", F.explode(walk("rows")).alias("c")).select("doc_id", "c.*")


def without_repeated_spans(chunks: DataFrame) -> DataFrame:
    """Collapse word spans that follow one another at once in prose chunks; token counts
    stay as they were."""

    @by_row("string")
    def collapse(text: str | None) -> str | None:
        return collapse_spans(text)[0]

    prose = F.col("dominant_type") == "prose"
    return chunks.withColumn("content", F.when(prose, collapse(F.when(prose, F.col("content")))).otherwise(F.col("content")))


def embedded(said: DataFrame, text_col: str = "sentence", model_dir: str | None = None) -> DataFrame:
    """Add ``embedding`` and ``tokens`` of each text, of a local model or its stand-in; a
    model is loaded once a worker."""

    @F.arrow_udf("struct<embedding:array<float>,tokens:bigint>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = embedder(model_dir)
        for (texts,) in pieces(parts):
            some = [t or "" for t in texts.to_pylist()]
            vectors = embed.sentences(some)[: len(some)]
            tokens = pa.array([embed.count(t) for t in some], pa.int64())
            yield pa.StructArray.from_arrays([as_lists(vectors), tokens], ["embedding", "tokens"])

    out = said.withColumn("_e", run(F.col(text_col)))
    return out.withColumn("embedding", F.col("_e.embedding")).withColumn("tokens", F.col("_e.tokens")).drop("_e")
