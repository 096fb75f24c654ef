"""Operators over atomic blocks: one row each, ``doc_id, ord, kind, content, page``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..functions import values as V
from ..functions.rows import by_row


def whole_blocks(blocks: DataFrame) -> DataFrame:
    """A chunk for each block as it is, with its type, flags and span."""
    return blocks.select(
        "doc_id",
        "ord",
        "content",
        C.token_count("content").alias("token_count"),
        F.lit(0).alias("span_start"),
        F.length("content").alias("span_end"),
        C.block_kind("kind").alias("dominant_type"),
        F.lit("atomic_block").alias("chunking_method"),
        (F.col("kind") == "code").alias("has_code"),
        (F.col("kind") == "formula").alias("has_math"),
        (F.col("kind") == "table").alias("has_table"),
    )


def visual_blocks(blocks: DataFrame) -> DataFrame:
    """Chunks of pictures, charts and figures that say something; ``context`` (the prose
    right before) speaks for those without caption and alternative text."""
    own = C.visual_content("caption", "alt_text")
    context = F.col("context") if "context" in blocks.columns else F.lit(None).cast("string")
    content = F.when(own.isNotNull() & context.isNotNull(), F.concat_ws("\n\n", context, own)).otherwise(F.coalesce(own, context))
    out = blocks.where(F.col("kind").isin(*V.VISUAL_TYPES)).select("doc_id", "ord", "kind", content.alias("content"))
    return out.where("content is not null").select(
        "*", C.token_count("content").alias("token_count"), F.lit("visual_block").alias("dominant_type"), F.lit("visual_reference").alias("chunking_method")
    )


def dispatch(blocks: DataFrame) -> DataFrame:
    """Add ``route``: visual, whole, or split for blocks over the large size."""
    route = F.when(F.col("kind").isin(*V.VISUAL_TYPES), "visual").when(C.token_count("content") <= V.LARGE_BLOCK, "whole")
    return blocks.withColumn("route", route.otherwise("split"))


_PART = "array<struct<content:string,type:string,name:string,lineno:int,end_lineno:int>>"


def code_parts(blocks: DataFrame) -> DataFrame:
    """``(doc_id, ord, part, language, content, type, name, lineno, end_lineno)`` of code.

    Python is cut by its syntax tree, scripts at functions, the rest at blank lines.
    """

    @by_row(_PART)
    def cut(code: str, language: str) -> list[dict]:
        return [{"content": t, "type": c["type"], "name": c.get("name"), "lineno": c.get("lineno"), "end_lineno": c.get("end_lineno")} for t, c in T.split_code(code, language)]

    named = F.col("language") if "language" in blocks.columns else F.lit(None).cast("string")
    known = blocks.where((F.col("kind") == "code") & F.col("content").isNotNull()).select("doc_id", "ord", "content", C.code_language("content", named).alias("lang"))
    out = known.select("doc_id", "ord", F.col("lang").alias("language"), F.posexplode(cut("content", "lang")).alias("part", "p"))
    return out.select("doc_id", "ord", "part", "language", "p.*")


def section_parts(blocks: DataFrame) -> DataFrame:
    """``(doc_id, ord, part, content)`` of code cut at blank lines and definitions."""
    cut = F.split("content", V.SECTION_RE)
    stripped = F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    return blocks.select("doc_id", "ord", F.posexplode(stripped).alias("part", "content"))


def table_parts(blocks: DataFrame, target: int = V.TABLE_CHILD) -> DataFrame:
    """Row groups of tables: ``doc_id, ord, part, content, row_start, row_end, column_headers``.

    The header ends at the first rule line among the first five. Groups are formed by a linear
    walk over the rows' token counts; a header's count weighs on every group.
    """
    lines = F.split(C.strip("content"), "\n")
    rule = F.filter(F.sequence(F.lit(0), F.least(F.lit(4), F.size("lines") - 1)), lambda i: F.get(F.col("lines"), i).rlike(V.RULE_LINE_RE))
    out = blocks.where(F.col("kind") == "table").select("doc_id", "ord", "content", lines.alias("lines"))
    out = out.withColumn("head", F.coalesce(F.get(rule, F.lit(0)) + 1, F.lit(0)))
    out = out.withColumn("header", F.array_join(F.slice("lines", F.lit(1), F.col("head")), "\n"))
    out = out.withColumn("rows", F.slice("lines", F.col("head") + 1, F.size("lines")))
    fixed = F.when(F.col("header") == "", F.lit(0).cast("long")).otherwise(C.token_count("header"))
    out = out.withColumn("fixed", fixed)

    @by_row("array<int>")
    def walk(costs: list[int], fixed: int) -> list[int]:
        return T.row_groups(costs, fixed, target)

    out = out.withColumn("starts", walk(F.transform("rows", C.token_count), "fixed"))
    out = out.select("*", F.posexplode_outer("starts").alias("part", "a"))
    end = F.coalesce(F.get("starts", F.col("part") + 1), F.size("rows"))
    some = F.array_join(F.slice("rows", F.col("a") + 1, end - F.col("a")), "\n")
    return out.select(
        "doc_id",
        "ord",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.when(F.col("part").isNull(), F.col("content")).when(F.col("header") != "", F.concat_ws("\n", "header", some)).otherwise(some).alias("content"),
        F.coalesce("a", F.lit(0)).alias("row_start"),
        F.coalesce(F.when(F.col("part").isNotNull(), end), F.lit(0)).alias("row_end"),
        F.when((F.col("part").isNotNull()) & (F.col("head") > 0), F.get("lines", F.lit(0))).otherwise("").alias("column_headers"),
    )


def formula_parts(blocks: DataFrame) -> DataFrame:
    """Parts of formulas: ``doc_id, ord, part, content, environment, step, split_method``.

    Several environments are a part each; of a single one the steps, if over three.
    """
    names = "|".join(V.FORMULA_ENVIRONMENTS)
    pattern = rf"(?s)\\begin\{{({names})\*?\}}.*?\\end\{{\1\*?\}}"
    kind = "array<struct<content:string,environment:string,step:int,split_method:string>>"
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    out = blocks.where(F.col("kind") == "formula").select("doc_id", "ord", "content", found.alias("envs"))
    out = out.withColumn("steps", F.split(F.get("envs", F.lit(0)), V.STEP_RE))
    none = F.lit(None).cast("string")
    each = F.transform("envs", lambda e: F.struct(e.alias("content"), F.regexp_extract(e, rf"\\begin\{{({names})", 1).alias("environment"), F.lit(None).cast("int").alias("step"), F.lit("environment").alias("split_method")))
    steps = F.transform("steps", lambda s, i: F.struct(F.regexp_replace(s, r"(?U)^\s+|\s+$", "").alias("content"), none.alias("environment"), i.alias("step"), F.lit("step_based").alias("split_method")))
    whole = F.array(F.struct(F.col("content"), none.alias("environment"), F.lit(None).cast("int").alias("step"), F.lit("none").alias("split_method")))
    parts = F.when(F.size("envs") > 1, each.cast(kind)).when(F.size("steps") > 3, F.filter(steps.cast(kind), lambda p: p["content"] != "")).otherwise(whole.cast(kind))
    return out.select("doc_id", "ord", F.posexplode(parts).alias("part", "p")).select("doc_id", "ord", "part", "p.*")


def parents_and_children(parts: DataFrame, whole_type: str | None = None) -> DataFrame:
    """From the parts of split blocks, whether each block is divided and into how many:
    ``doc_id, ord, child_count, divided``. A single part of ``whole_type`` is the block."""
    n = F.count("*")
    alone = n == 1 if whole_type is None else (n == 1) & (F.max(F.coalesce("type", F.lit(""))) == whole_type)
    out = parts.groupBy("doc_id", "ord").agg(n.alias("child_count"), (~alone).alias("divided"))
    return out


def number(chunks: DataFrame) -> DataFrame:
    """Add ``sequence``, 0-based in reading order (``ord``, then ``part`` if present)."""
    order = ["ord", *(["part"] if "part" in chunks.columns else [])]
    return chunks.withColumn("sequence", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1)
