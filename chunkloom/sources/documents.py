"""Parsed documents: JSON in, nested rows, elements out, and back to JSON.

A document row is ``doc_id, pages, metadata``; pages are an array of structs with their
elements. Metadata of documents and elements stays JSON text, in which numbers, flags and
nested values are what they were; operators read single keys of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bounded

BBOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
ELEMENT = f"struct<element_type:string,content:string,bbox:{BBOX},page:int,confidence:double,metadata:string>"
PAGE = f"struct<page_number:int,width:double,height:double,elements:array<{ELEMENT}>>"
PAGES = f"array<{PAGE}>"
#: Keys beside an element's metadata that belong in it.
OWN_KEYS = ("start_time", "end_time", "words")
_RAW_ELEMENT = f"struct<type:string,element_type:string,content:string,bbox:{BBOX},page:int,confidence:double,metadata:string,{','.join(f'{k}:variant' for k in OWN_KEYS)}>"
_RAW_PAGES = f"array<struct<page_number:int,width:double,height:double,elements:array<{_RAW_ELEMENT}>,regions:array<{_RAW_ELEMENT}>>>"
_RAW = f"pages {_RAW_PAGES}, metadata string"


def _object(text: Column) -> Column:
    """JSON text of an object, ``{}`` for anything else."""
    return F.coalesce(F.when(text.rlike(r"^\s*\{"), F.btrim(text)), F.lit("{}"))


def _element(e: Column) -> Column:
    x_min, x_max = bounded(e["bbox"]["x_min"], e["bbox"]["x_max"])
    y_min, y_max = bounded(e["bbox"]["y_min"], e["bbox"]["y_max"])
    given = _object(e["metadata"])
    keys = F.json_object_keys(given)
    own = [F.when(~F.coalesce(F.array_contains(keys, k), F.lit(False)), F.concat(F.lit(f'"{k}":'), F.to_json(e[k]))) for k in OWN_KEYS]
    inside = F.btrim(F.substring(given, F.lit(2), F.length(given) - 2))
    merged = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inside, F.lit("")), *own), F.lit("}"))
    return F.struct(
        F.coalesce(F.nullif(e["type"], F.lit("")), e["element_type"], F.lit("text")).alias("element_type"),
        F.coalesce(e["content"], F.lit("")).alias("content"),
        F.struct(x_min.alias("x_min"), y_min.alias("y_min"), x_max.alias("x_max"), y_max.alias("y_max")).alias("bbox"),
        F.coalesce(e["page"], F.lit(0)).alias("page"),
        F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence"),
        F.when(merged != "{}", merged).alias("metadata"),
    )


def decode_documents(docs: DataFrame, json_col: str = "json", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, pages, metadata`` from JSON text, forgiving about keys.

    A page's ``regions`` stand in where ``elements`` is missing (not where it is empty);
    sizes of 0 or none are 1000; boxes keep fractions, within 0 to 1000; an element's page
    is 0 unless given; times and words beside the metadata go into it, if it doesn't have
    them (null ones are left out). Text that is no JSON object and null give no pages.
    """
    got = F.from_json(F.col(json_col), _RAW)

    def page(p: Column) -> Column:
        size = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1000.0))
        some = F.coalesce(p["elements"], p["regions"], F.array().cast(f"array<{_RAW_ELEMENT}>"))
        return F.struct(p["page_number"].alias("page_number"), size(p["width"]).alias("width"), size(p["height"]).alias("height"), F.transform(some, _element).alias("elements"))

    parsed = docs.select(F.col(id_col).alias("doc_id"), got.alias("d"))
    pages = F.transform(F.coalesce(F.col("d.pages"), F.array().cast(_RAW_PAGES)), page)
    return parsed.select("doc_id", pages.alias("pages"), _object(F.col("d.metadata")).alias("metadata"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON files, one each; ``doc_id`` is the file's path."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"))
    return decode_documents(text)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of Markdown files; ``doc_id`` is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def from_dicts(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Documents of Python dicts, numbered; those of objects with ``to_dict`` too."""
    import json

    rows = [(i, json.dumps(d.to_dict() if hasattr(d, "to_dict") else d)) for i, d in enumerate(documents)]
    return decode_documents(spark.createDataFrame(rows, "doc_id long, json string"))


def explode_elements(docs: DataFrame) -> DataFrame:
    """A row for each element: ``doc_id, ord`` and its fields (``kind`` for its type), in the
    order of the lists, whatever the page numbers say."""
    pages = docs.select("doc_id", F.posexplode("pages").alias("page_ix", "p"))
    rows = pages.select("doc_id", "page_ix", F.posexplode("p.elements").alias("elem_ix", "e"))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("page_ix", "elem_ix")) - 1
    return rows.select("doc_id", order.cast("long").alias("ord"), F.col("e.element_type").alias("kind"), "e.content", "e.page", "e.bbox", "e.confidence", "e.metadata")


def encode_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, json`` of documents; metadata of elements that is empty is left out."""
    element = lambda e: F.struct(e["element_type"].alias("type"), e["content"].alias("content"), e["bbox"].alias("bbox"), e["page"].alias("page"), e["confidence"].alias("confidence"), F.parse_json(e["metadata"]).alias("metadata"))
    page = lambda p: F.struct(p["page_number"].alias("page_number"), p["width"].alias("width"), p["height"].alias("height"), F.transform(p["elements"], element).alias("elements"))
    return docs.select("doc_id", F.to_json(F.struct(F.transform("pages", page).alias("pages"), F.parse_json("metadata").alias("metadata"))).alias("json"))
