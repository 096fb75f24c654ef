"""Documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``docs``. Null and empty texts leave at language
identification; what else a stage does with odd rows stands with its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import drop_scratch, file_order, fresh_name, kept, read_table
from chunkloom.llm.exact_dedup import distinct_documents
from chunkloom.llm.langid import UNKNOWN, judged
from chunkloom.llm.mixing import mixed_documents
from chunkloom.llm.packing import pack
from chunkloom.llm.simhash import without_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go."""
    name = fresh_name(docs, "judged")
    known = judged(docs, name).where(F.col(f"{name}.lang_pred") != UNKNOWN)
    return known.select(*[f"`{c}`" for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies (five-word shingles, Jaccard 0.8 or more)."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix passes over them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with each document's place in the order of
    ``docs`` as ``position``: sequences hold documents that stand near one another there."""
    place = fresh_name(docs, "place")
    return pack(file_order(docs, place), order_col=place)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", packing),
]

#: Language models, fingerprints and tokenizers are beyond SQL; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written in between; what a stage has
    read is dropped when it is written itself."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = kept(stage(spark, docs, sf_dir), name.split()[0].lower())
        for old in before:
            drop_scratch(spark, old)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
