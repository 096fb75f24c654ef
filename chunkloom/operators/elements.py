"""Operators over a stream of elements, one row each: ``doc_id, ord, kind, content, page``.

``ord`` is the reading order within a document. Windows and groups are by document (or
finer), so all of them share one shuffle by ``doc_id`` and no task holds more than a
document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V
from ..functions.rows import by_row
from ..functions.text import bled_heading, far_pages, left_out, trails


def by_document():
    return W.partitionBy("doc_id").orderBy("ord")


def without_repeats(elements: DataFrame) -> DataFrame:
    """Drop elements whose content and type were kept on this page or a neighbouring one.

    The last kept page is what counts, so of pages 1 to 4 the first and third stay; the
    pages of one content go through a linear walk. Null content never repeats and stays.
    """
    row = F.struct("ord", *[c for c in elements.columns if c not in ("doc_id", "ord")])
    key = F.coalesce(F.lower(C.strip("content")), F.concat(F.lit("\0"), F.col("ord").cast("string")))
    groups = elements.groupBy("doc_id", "kind", key.alias("key")).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    @by_row("array<boolean>")
    def walk(pages: list[int | None] | None) -> list[bool] | None:
        return None if pages is None else far_pages(pages)

    stays = walk(F.when(F.size("rows") > 1, F.transform("rows", lambda r: r["page"])))
    groups = groups.select("doc_id", "rows", stays.alias("ok"))
    kept = F.when(F.col("ok").isNull(), F.col("rows")).otherwise(F.filter("rows", lambda r, i: F.get(F.col("ok"), i)))
    out = groups.select("doc_id", F.explode(kept).alias("r"))
    return out.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in elements.columns if c != "doc_id"])


def without_bleed(elements: DataFrame) -> DataFrame:
    """Cut from ``section_header`` rows the lines that the next text begins with.

    Only headings of more than one line go to Python.
    """

    @by_row("string")
    def cut(heading: str | None, following: str | None) -> str | None:
        return bled_heading(heading, following) if heading is not None else None

    after = W.partitionBy("doc_id").orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    text = F.when(C.strip("content") != "", F.col("content"))
    marked = elements.withColumn("_next", F.first(text, ignorenulls=True).over(after))
    may = (F.col("kind") == "section_header") & F.contains("content", F.lit("\n")) & F.col("_next").isNotNull()
    fixed = F.when(may, cut(F.when(may, F.col("content")), F.when(may, F.col("_next")))).otherwise(F.col("content"))
    return marked.withColumn("content", fixed).drop("_next")


def without_skipped(elements: DataFrame) -> DataFrame:
    return elements.where(~F.col("kind").isin(*V.SKIPPED_TYPES))


def with_headings(elements: DataFrame) -> DataFrame:
    """Add ``depth``: the level of a valid heading, else null. Columns ``level`` and
    ``style`` are used where present."""
    given = lambda c: F.col(c) if c in elements.columns else F.lit(None).cast("string")
    level = C.heading_level("kind", given("level"), given("style"))
    return elements.withColumn("depth", F.when(C.is_heading("content"), level))


def _states(elements: DataFrame, walk, what: Column) -> DataFrame:
    """``elements`` with ``_state``: at a heading what ``walk``, a linear function of a
    document's headings (arrays of ``depth`` and of ``what``), gives for it; at other rows
    that of the last heading."""
    row = F.struct("ord", "depth", what.alias("what"))
    heads = elements.where(F.col("depth").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("h"))
    told = walk(F.transform("h", lambda h: h["depth"]), F.transform("h", lambda h: h["what"]))
    told = heads.select("doc_id", F.explode(F.arrays_zip(F.transform("h", lambda h: h["ord"]).alias("ord"), told.alias("state"))).alias("s"))
    states = told.select("doc_id", F.col("s.ord").alias("ord"), F.struct(F.col("s.state").alias("state")).alias("_state"))
    sofar = by_document().rowsBetween(W.unboundedPreceding, 0)
    return elements.join(states, ["doc_id", "ord"], "left").withColumn("_state", F.last("_state", ignorenulls=True).over(sofar)["state"])


def with_trail(elements: DataFrame) -> DataFrame:
    """Add ``trail`` (headings above and at a row, outermost first) and ``nearest``.

    A heading of level L is live while no shallower one came after it, and is replaced by
    the next of its own level; levels may be of any depth.
    """
    walk = by_row("array<array<string>>")(trails)
    trail = F.coalesce(F.col("_state"), F.array().cast("array<string>"))
    out = _states(elements, walk, C.strip("content")).withColumn("trail", trail).drop("_state")
    return out.withColumn("nearest", F.try_element_at("trail", F.lit(-1)))


def without_backmatter(elements: DataFrame) -> DataFrame:
    """Drop backmatter headings and all below them, up to another heading as shallow."""
    walk = by_row("array<boolean>")(left_out)
    out = _states(elements, walk, C.is_backmatter("content"))
    return out.where(~F.coalesce(F.col("_state"), F.lit(False))).drop("_state")


def with_runs(elements: DataFrame) -> DataFrame:
    """Add ``role`` (heading, block, prose) and ``run``: consecutive prose rows share one,
    every heading and block has its own."""
    role = F.when(C.is_atomic("kind"), "block").when(F.col("depth").isNotNull(), "heading").otherwise("prose")
    out = elements.withColumn("role", role)
    begins = (F.col("role") != "prose") | (F.coalesce(F.lag("role").over(by_document()), F.lit("")) != "prose")
    return out.withColumn("run", F.sum(begins.cast("int")).over(by_document()))


def with_context(elements: DataFrame) -> DataFrame:
    """Add ``context`` to blocks (the caption or introduction right before) and drop the
    rows it was taken from. Needs ``role``."""
    before = F.lag(F.when((F.col("role") == "prose") & C.introduces_block("kind", "content"), C.strip("content"))).over(by_document())
    taken = (F.lead("role").over(by_document()) == "block") & (F.col("role") == "prose") & C.introduces_block("kind", "content")
    out = elements.withColumn("context", F.when(F.col("role") == "block", F.nullif(before, F.lit(""))))
    return out.withColumn("_taken", F.coalesce(taken, F.lit(False))).where(~F.col("_taken")).drop("_taken")


def with_pending(elements: DataFrame) -> DataFrame:
    """Add ``pending`` to the first row of each prose run and to blocks: the headings since
    the last content, joined by blank lines. Needs ``role`` and ``run``.

    Blocks consume them without showing them; headings after the last content are ``pending``
    of no row and come from ``trailing_headings``.
    """
    content = F.sum((F.col("role") != "heading").cast("int")).over(by_document().rowsBetween(W.unboundedPreceding, -1))
    out = elements.withColumn("_gap", F.coalesce(content, F.lit(0)))
    text = F.when(F.col("role") == "heading", F.struct("ord", C.strip("content").alias("t")))
    heads = F.array_sort(F.collect_list(text).over(W.partitionBy("doc_id", "_gap")))
    joined = F.array_join(F.transform(heads, lambda h: h["t"]), "\n\n")
    out = out.withColumn("pending", F.when(F.col("role") != "heading", F.nullif(joined, F.lit(""))))
    return out.drop("_gap")


def trailing_headings(elements: DataFrame) -> DataFrame:
    """``(doc_id, headings)`` after the last content of each document. Needs ``role``."""
    rest = F.max(F.when(F.col("role") != "heading", F.col("ord"))).over(W.partitionBy("doc_id"))
    out = elements.withColumn("_last", rest).where((F.col("role") == "heading") & (F.col("_last").isNull() | (F.col("ord") > F.col("_last"))))
    rows = F.array_sort(F.collect_list(F.struct("ord", C.strip("content").alias("t"))))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda h: h["t"]), "\n\n").alias("headings"))
