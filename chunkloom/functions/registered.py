"""The sequential functions as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T


def register(spark: SparkSession) -> list[str]:
    """Register ``markdown_elements(text)``, ``sentence_spans(text)``, ``collapse_spans(text)``
    and ``split_code(text, language)``; returns their names. All give null for null."""
    from ..sources.markdown import parse_markdown

    @F.pandas_udf("array<struct<kind:string,content:string>>")
    def markdown_elements(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([None if t is None else [{"kind": k, "content": c} for k, c, _ in parse_markdown(t)] for t in texts], dtype=object)

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def sentence_spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([None if t is None else [{"begin": a, "end": b} for a, b in T.sentence_spans(t)] for t in texts], dtype=object)

    @F.pandas_udf("string")
    def collapse_spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([T.collapse_spans(t)[0] for t in texts], dtype=object)

    @F.pandas_udf("array<struct<content:string,type:string>>")
    def split_code(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in parts:
            yield pd.Series([None if t is None else [{"content": c, "type": m["type"]} for c, m in T.split_code(t, T.code_language(t, lang))] for t, lang in zip(texts, languages)], dtype=object)

    made = {"markdown_elements": markdown_elements, "sentence_spans": sentence_spans, "collapse_spans": collapse_spans, "split_code": split_code}
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
