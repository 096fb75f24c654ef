"""Structure-aware document chunking on Spark.

``chunk_documents`` and ``chunk_markdown`` take DataFrames with a document a row;
``make_chunker`` binds their options; ``chunk_elements`` chunks one document in memory.
"""

from __future__ import annotations

from functools import partial
from types import SimpleNamespace

from .functions.embed import Embedder, ModelEmbedder, release
from .plans.chunking import chunk_documents, chunk_markdown, markdown_documents
from .plans.kernel import Chunk, Element, Options, chunk_elements
from .plans.service import chunk_request
from .sources.documents import decode_documents, explode_elements, from_dicts, read_json, read_markdown
from .sources.markdown import parse_markdown

__version__ = "0.1.0"
__all__ = [
    "Chunk", "Element", "Embedder", "ModelEmbedder", "Options", "chunk_documents", "chunk_elements", "chunk_markdown",
    "chunk_request", "decode_documents", "explode_elements", "from_dicts", "make_chunker", "markdown_documents",
    "parse_full_page_output", "parse_markdown", "read_json", "read_markdown", "release",
]


def parse_full_page_output(text: str, page: int) -> list[Element]:
    """Elements of a Markdown text on a page; the older name of a parse with a page."""
    return [Element(k, c, page, m or {}) for k, c, m in parse_markdown(text)]


def make_chunker(**options) -> SimpleNamespace:
    """``documents`` and ``markdown``, the two chunking functions with these options bound;
    a call may still set its own."""
    return SimpleNamespace(documents=partial(chunk_documents, **options), markdown=partial(chunk_markdown, **options))
