"""Operators from prose text to sentences and packed chunks.

A sentence is a row ``doc_id, run, pos, text, ...``; ``run`` is a stretch of prose without
a heading or block inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V
from ..functions.rows import by_row
from ..functions.text import fallback_tokens
from ..functions.text import sentence_spans as spans_of
from ..functions.text import surviving as stays
from ..plans.kernel import HARD, SOFT, spans


def by_run():
    return W.partitionBy("doc_id", "run").orderBy("pos")


def sentence_spans(texts: DataFrame, keys: list[str], text_col: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """A row for each sentence: the keys, ``nth`` (0-based), ``begin``, ``end``, ``sentence``.

    Spans are relative to the stripped text and cover it. Blank and null texts have no
    sentence. Further ``carried`` columns come along with each sentence. A text is cut
    within its row, so nothing is shuffled.
    """

    @by_row("array<struct<begin:int,end:int,sentence:string>>")
    def cut(t: str) -> list[dict]:
        return [{"begin": a, "end": b, "sentence": t[a:b].strip()} for a, b in spans_of(t)]

    stripped = texts.select(*keys, *carried, C.strip(text_col).alias("_t")).where("_t <> ''")
    said = stripped.select(*keys, *carried, F.posexplode(cut("_t")).alias("nth", "s"))
    as_long = [F.col(c).cast("long").alias(c.removeprefix("s.")) for c in ("nth", "s.begin", "s.end")]
    return said.select(*keys, *carried, *as_long, "s.sentence")


def text_chunks(texts: DataFrame, text_col: str = "text", max_tokens: int = V.MAX_TOKENS, overlap_tokens: int = V.OVERLAP_TOKENS, page: int = 1) -> DataFrame:
    """``chunk_rows`` of whole texts, each one element and one run: ``doc_id, run, nth``,
    content, pages, spans, count. Sentences and chunks are made within the row, so that
    nothing is shuffled; nothing parts sentences but the size."""

    @by_row("array<struct<content:string,span_start:bigint,span_end:bigint>>")
    def pack(t: str) -> list[dict]:
        at = spans_of(t)
        said = [t[a:b].strip() for a, b in at]
        ranges = spans([fallback_tokens(s) for s in said], [HARD] + [0] * (len(said) - 1), max_tokens, overlap_tokens) if said else ()
        return [{"content": " ".join(said[a:e]), "span_start": at[a][0], "span_end": at[e - 1][1]} for a, e in ranges]

    stripped = texts.select("doc_id", C.strip(text_col).alias("_t")).where("_t <> ''")
    out = stripped.select("doc_id", F.lit(0).alias("run"), F.posexplode(pack("_t")).alias("nth", "c"))
    out = out.select("doc_id", "run", "nth", "c.content", F.array(F.lit(page)).alias("page_numbers"), "c.span_start", "c.span_end")
    return out.withColumn("token_count", C.token_count("content"))


def with_positions(said: DataFrame) -> DataFrame:
    """From ``doc_id, run, ord, nth, begin, end, size`` (size: the element's length) add
    ``pos`` within the run and offsets ``start_idx, end_idx`` relative to it; elements are
    one character apart."""
    order = W.partitionBy("doc_id", "run").orderBy("ord", "nth")
    size = F.col("size") + 1
    offset = F.sum(F.when(F.col("nth") == 0, size)).over(order) - size
    return (
        said.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("start_idx", F.col("begin") + offset)
        .withColumn("end_idx", F.col("end") + offset)
    )


def without_prefixes(said: DataFrame) -> DataFrame:
    """Mark (``cut_off``) sentences that the next one repeats and goes on from."""
    norm, after = C.squeezed("sentence"), F.lead(C.squeezed("sentence")).over(by_run())
    cut = (F.length(norm) >= V.PREFIX_CHARS) & after.startswith(norm) & (F.length(after) >= F.length(norm) + V.PREFIX_ADDED)
    return said.withColumn("cut_off", F.coalesce(cut, F.lit(False)))


def surviving(said: DataFrame) -> DataFrame:
    """Drop cut-off sentences and those equal to one of the last eight that stayed.

    Each run is one array, which an Arrow function walks in linear time; ``pos`` is not
    renumbered.
    """
    fields = [c for c in said.columns if c not in ("doc_id", "run", "pos")]
    rows = F.array_sort(F.collect_list(F.struct("pos", C.squeezed("sentence").alias("_norm"), *fields)))

    walk = by_row("array<boolean>")(stays)

    runs = said.groupBy("doc_id", "run").agg(rows.alias("rows"))
    runs = runs.select("doc_id", "run", "rows", walk(F.transform("rows", lambda r: r["_norm"])).alias("ok"))
    kept = F.filter("rows", lambda r, i: F.get(F.col("ok"), i))
    out = runs.select("doc_id", "run", F.explode(kept).alias("r"))
    return out.select("doc_id", "run", *[F.col(f"r.{c}").alias(c) for c in said.columns if c not in ("doc_id", "run")])


def with_boundaries(said: DataFrame, threshold: float = V.BOUNDARY_THRESHOLD) -> DataFrame:
    """Add ``boundary`` before each sentence: hard, soft or null. Needs ``kind`` and
    ``opens``; an ``embedding`` column is used where present, else nothing drops."""
    kind, before = F.col("kind"), F.lag("kind").over(by_run())
    alike = C.is_prose_type(kind) & C.is_prose_type(before)
    drops = F.lit(False)
    if "embedding" in said.columns:
        drops = C.cosine(F.lag("embedding").over(by_run()), F.col("embedding")) < threshold
    return said.withColumn(
        "boundary",
        F.when(before.isNull() | kind.startswith("section_header"), "hard")
        .when((kind != before) & ~alike, "hard")
        .when(F.col("opens"), F.when(alike, "soft").otherwise("hard"))
        .when(drops, "soft"),
    )


def _packed(said: DataFrame, max_tokens: int, overlap_tokens: int, fields: Sequence[str]) -> DataFrame:
    """``doc_id, run, nth, s`` (first and last place in the run) and ``rows``, the run's
    sentences in order. Each run is one array, which an Arrow function walks in linear time."""
    code = F.when(F.col("boundary") == "hard", HARD).when(F.col("boundary") == "soft", SOFT).otherwise(0)
    rows = F.array_sort(F.collect_list(F.struct("pos", C.token_count("sentence").alias("n"), code.alias("b"), *fields)))

    @by_row("array<struct<first:int,last:int>>")
    def walk(tokens: list[int], before: list[int]) -> list[dict]:
        return [{"first": a, "last": e - 1} for a, e in spans(tokens, before, max_tokens, overlap_tokens)]

    runs = said.groupBy("doc_id", "run").agg(rows.alias("rows"))
    found = walk(F.transform("rows", lambda r: r["n"]), F.transform("rows", lambda r: r["b"]))
    return runs.select("doc_id", "run", "rows", found.alias("found")).select("doc_id", "run", "rows", F.posexplode("found").alias("nth", "s"))


def packed(said: DataFrame, max_tokens: int = V.MAX_TOKENS, overlap_tokens: int = V.OVERLAP_TOKENS) -> DataFrame:
    """``(doc_id, run, nth, first, last)``: which sentences, by ``pos``, make each chunk."""
    out = _packed(said, max_tokens, overlap_tokens, [])
    return out.select("doc_id", "run", "nth", F.get("rows", F.col("s.first"))["pos"].alias("first"), F.get("rows", F.col("s.last"))["pos"].alias("last"))


def chunk_rows(said: DataFrame, max_tokens: int = V.MAX_TOKENS, overlap_tokens: int = V.OVERLAP_TOKENS) -> DataFrame:
    """Packed chunks with their text: ``doc_id, run, nth``, content, count, pages, spans. A
    paragraph begins after a blank line."""
    out = _packed(said, max_tokens, overlap_tokens, ["opens", "sentence", "start_idx", "end_idx", "page"])
    out = out.select("doc_id", "run", "nth", F.slice("rows", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1).alias("r"))
    part = F.transform("r", lambda s, i: F.concat(F.when(i == 0, "").when(s["opens"], "\n\n").otherwise(" "), s["sentence"]))
    pages = F.array_sort(F.array_distinct(F.transform("r", lambda s: s["page"])))
    out = out.select("doc_id", "run", "nth", F.array_join(part, "").alias("content"), pages.alias("page_numbers"), F.element_at("r", 1)["start_idx"].alias("span_start"), F.element_at("r", -1)["end_idx"].alias("span_end"))
    return out.withColumn("token_count", C.token_count("content"))


def section_type(said: DataFrame, keys: list[str]) -> DataFrame:
    """The one kind of section that a chunk's sentences name, null where they differ."""
    kinds = F.collect_set(F.nullif("section", F.lit("")))
    return said.groupBy(*keys).agg(kinds.alias("k")).select(*keys, F.when(F.size("k") == 1, F.get("k", F.lit(0))).alias("section_type"))


def time_range(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest start, latest end and number of distinct segments of each group; groups
    without a start have none."""
    timed = F.col("start_time").isNotNull()
    pair = F.when(timed, F.struct("start_time", F.coalesce(F.col("end_time").cast("string"), F.lit("-")).alias("e")))
    out = segments.groupBy(*keys).agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count_distinct(pair).alias("segment_count"))
    return out.where("start_time is not null")
