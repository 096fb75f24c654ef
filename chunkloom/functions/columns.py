"""Column expressions of the element, sentence and chunk operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .rows import as_matrix, pieces


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def squeezed(c: Column | str) -> Column:
    """Lower case, each run of white space one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), r"(?U)\s+", " "))


def token_count(c: Column | str) -> Column:
    """The stand-in's count: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(c)) / 4)).cast("long")


def heading_level(kind: Column | str, level: Column | str, style: Column | str) -> Column:
    """Depth of a heading type; null for other types. ``level`` may be text."""
    kind = _col(kind)
    suffix = F.regexp_extract(kind, V.LEVEL_RE, 1)
    styled = F.regexp_extract(F.coalesce(_col(style), F.lit("")), V.STYLE_RE, 1)
    return (
        F.when(kind == "title", 1)
        .when(kind == "subtitle", 2)
        .when(~kind.startswith("section_header"), F.lit(None))
        .when(suffix != "", suffix.cast("int"))
        .otherwise(F.coalesce(_col(level).try_cast("int"), F.when(styled != "", styled.cast("int")), F.lit(1)))
    )


def is_heading(text: Column | str) -> Column:
    """Whether a text looks like a heading and not like a sentence's fragment."""
    t = strip(text)
    fits = F.length(t).between(*V.HEADING_CHARS)
    return fits & (t.rlike(V.NUMBERED_RE) | ~t.rlike(V.FRAGMENT_RE))


def is_backmatter(text: Column | str) -> Column:
    return strip(text).rlike("(?i)" + V.BACKMATTER_RE)


def is_atomic(kind: Column | str) -> Column:
    return _col(kind).isin(*V.ATOMIC_TYPES)


def is_prose_type(kind: Column | str) -> Column:
    return _col(kind).isin(*V.PROSE_TYPES)


def introduces_block(kind: Column | str, text: Column | str) -> Column:
    """Whether a prose element right before a block goes with it."""
    t = strip(text)
    said = t.rlike("(?i)" + V.INTRO_RE) | t.rlike("(?i)" + V.CAPTION_RE)
    return (_col(kind) == "caption") | ((token_count(t) <= V.CONTEXT_TOKENS) & said)


def code_language(code: Column | str, named: Column | str) -> Column:
    code, named = _col(code), F.lower(F.coalesce(_col(named), F.lit("")))
    any_in = lambda text, signs: F.greatest(*[F.contains(text, F.lit(s)) for s in signs])
    out = F
    for name, language in V.LANGUAGE_NAMES.items():
        out = out.when(named == name, F.lit(language))
    typed = F.when(any_in(code, V.TYPED_SIGNS), "typescript").otherwise("javascript")
    return out.when(any_in(code, V.PYTHON_SIGNS), "python").when(any_in(F.lower(code), V.SCRIPT_SIGNS), typed).otherwise("unknown")


def block_kind(kind: Column | str) -> Column:
    kind = _col(kind)
    out = F.when(kind.isin(*V.VISUAL_TYPES), "visual_block")
    for k, name in V.BLOCK_KINDS.items():
        out = out.when(kind == k, name)
    return out.otherwise("mixed")


def visual_content(caption: Column | str, alt: Column | str) -> Column:
    """Caption and alternative text, those that aren't empty; null if nothing is left."""
    text = strip(F.concat_ws("\n", F.nullif(_col(caption), F.lit("")), F.nullif(_col(alt), F.lit(""))))
    return F.nullif(text, F.lit(""))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0.5 where a vector is missing, 0 where one has no length."""

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for columns in pieces(parts):
            yield pa.array(_cosines(*columns), pa.float64())

    return run(_col(a), _col(b))


def _cosines(a: pa.ListArray, b: pa.ListArray) -> np.ndarray | list[float | None]:
    x, y = as_matrix(a), as_matrix(b)
    if x is None or y is None or x.shape != y.shape:
        return [_cosine(*pair) for pair in zip(a.to_pylist(), b.to_pylist())]
    size = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    return np.where(size == 0, 0.0, np.einsum("ij,ij->i", x, y) / np.where(size == 0, 1.0, size))


def _cosine(a: list | None, b: list | None) -> float | None:
    """Of one pair; null for vectors with nulls in them or of different lengths."""
    if a is None or b is None:
        return 0.5
    if None in a or None in b:
        return None
    x, y = np.array(a, np.float64), np.array(b, np.float64)
    size = float(np.sqrt(x @ x) * np.sqrt(y @ y))
    return 0.0 if size == 0 else None if len(x) != len(y) else float(x @ y) / size


def bounded(low: Column | str, high: Column | str) -> tuple[Column, Column]:
    """A pair of coordinates in order and within 0 to 1000; missing ones are the ends."""
    a, b = F.coalesce(_col(low), F.lit(0)), F.coalesce(_col(high), F.lit(1000))
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(1000), x))
    return clamp(F.least(a, b)), clamp(F.greatest(a, b))
